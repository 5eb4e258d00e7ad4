"""Paragraph repeats against all pairs by exact Jaccard similarity, passages against all windows of words."""

import random

import numpy as np

from tallyfield.llm import common
from tallyfield.llm import paragraph_dedup as P


def corpus(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    base = [words(60) for _ in range(6)]
    docs = []
    for k in range(90):
        lines = [" ".join(words(rng.randrange(1, 80))) for _ in range(3)]
        if k % 2:
            para = list(base[k % 6])
            for _ in range(rng.randrange(0, 4)):
                para[rng.randrange(len(para))] = rng.choice(vocab)
            lines.insert(rng.randrange(4), " ".join(para).upper() if k % 5 == 0 else " ".join(para))
        docs.append("\n".join(lines))
    return docs + [None, "", "\n\n", "short line", "short line", docs[3], docs[3], " ".join(words(60_000))]


def units(text, least):
    """(first word, words) of the paragraphs of a text: long lines, and runs of shorter ones."""
    out, run, at, start = [], [], 0, 0
    for line in [*(text or "").split("\n"), ""]:
        w = line.lower().split()
        if not w or len(w) >= least:
            if len(run) >= least:
                out.append((start, tuple(run)))
            run = []
            if len(w) >= least:
                out.append((at, tuple(w)))
        else:
            start = start if run else at
            run += w
        at += len(w)
    return out


def brute(texts, ids, least=P.MIN_WORDS, threshold=0.8, within=False):
    """{(doc, first word, words): kept place} of the paragraphs that have a like one."""
    places = [(doc, at, w) for doc, t in zip(ids, texts) for at, w in units(t, least)]
    distinct = sorted({w for *_, w in places})
    sets = [{w[i : i + 5] for i in range(max(1, len(w) - 4))} for w in distinct]
    root = list(range(len(distinct)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both / (len(sets[i]) + len(sets[j]) - both) >= threshold:
                root[top(i)] = top(j)
    at = {w: top(i) for i, w in enumerate(distinct)}
    groups = {}
    for doc, pos, w in places:
        groups.setdefault(at[w], []).append((doc, pos, len(w)))
    return {x: min(g)[:2] for g in groups.values() if len(g) > 1 and (within or len({d for d, *_ in g}) > 1) for x in g}


def brute_left(texts, span=P.SPAN, least=P.MIN_WORDS, within=False):
    """Words that stay of every text: not in a removed paragraph, nor in a later copy of a window alone."""
    gone = {}
    for (doc, at, n), kept in brute(texts, range(len(texts)), least, within=within).items():
        if (doc, at) != kept:
            gone.setdefault(doc, set()).update(range(at, at + n))
    seen, words = {}, {}
    for doc, t in enumerate(texts):
        w = words[doc] = (t or "").lower().split()
        away = gone.setdefault(doc, set())
        for i in range(len(w) - span + 1):
            if not any(k in away for k in range(i, i + span)):
                seen.setdefault(tuple(w[i : i + span]), []).append((doc, i))
    keep, drop = set(), set()
    for places in seen.values():
        if len(places) > 1 and (within or len({d for d, _ in places}) > 1):
            keep |= {(places[0][0], places[0][1] + k) for k in range(span)}
            drop |= {(d, i + k) for d, i in places[1:] for k in range(span)}
    return {d: [x for i, x in enumerate(w) if i not in gone[d] and (d, i) not in drop - keep] for d, w in words.items()}


def check_left(df, texts, repeats, **kw):
    want = brute_left(texts, **kw)
    left = {r["doc_id"]: r["text"] for r in P.remove_repeats(df, repeats).collect()}
    for doc, t in enumerate(texts):
        assert (left[doc] is None) == (t is None)
        assert (left[doc] or "").lower().split() == want[doc], doc
        lines = (left[doc] or "").split("\n")
        assert [x for x in lines if not x.split()] == [x for x in (t or "").split("\n") if not x.split()] or not left[doc]


def test_against_all_pairs(frame, monkeypatch):
    texts = corpus()
    df = frame(texts)
    want = brute(texts, range(len(texts)))
    assert len(want) > 20

    def check():
        rows = P.find_repeats(df).collect()
        got = {(r["doc_id"], r["first_word"], r["n_words"]): (r["kept_doc_id"], r["kept_first_word"]) for r in rows}
        assert {k: got.get(k) for k in want} == want
        assert all(r["removed"] == ((r["doc_id"], r["first_word"]) != (r["kept_doc_id"], r["kept_first_word"])) for r in rows)

    check()
    monkeypatch.setattr(P, "BLOCK_BYTES", 2400)  # buckets go as pairs of blocks
    monkeypatch.setattr(common, "CHUNK", 700)
    check()


def test_removal(frame):
    texts = corpus()
    df = frame(texts)
    repeats = P.find_repeats(df)
    assert P.remove_repeats(df, repeats).columns == df.columns
    check_left(df, texts, repeats)
    check_left(df, texts, P.find_repeats(df, min_words=20), least=20)
    check_left(df, texts, P.find_repeats(df, within=True), within=True)


def test_null_ids_repeated_rows_and_empty_table(frame):
    line = " ".join(f"a{i}" for i in range(60))
    rows = P.find_repeats(frame([line, line, line, "x"], ids=[None, 4, 4, 7]), within=True).collect()
    assert [(r["doc_id"], r["removed"]) for r in rows] == [(4, False), (4, False)]
    assert P.find_repeats(frame([line, line, line, "x"], ids=[None, 4, 4, 7])).collect() == []
    assert P.find_repeats(frame([])).collect() == []


def test_bands():
    b = P.tune_bands(0.8, 0.999, 64)
    assert P.tune_bands() == P.Bands(13, 3)
    assert b.count * b.rows <= 64 and 1 - (1 - 0.8**b.rows) ** b.count >= 0.999


def test_links_span_components():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 30, 20).astype(np.uint64)) for _ in range(60)]
    for threshold in (0.3, 0.5, 0.7):
        root = list(range(60))

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        close = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= threshold
        found = P.links(sets, threshold)
        assert all(close(i, j) for i, j in found)
        for i, j in found:
            assert top(i) != top(j)
            root[top(i)] = top(j)
        assert all(top(i) == top(j) for i in range(60) for j in range(i) if close(i, j))


def test_passages_inside_unlike_lines(frame):
    rng = random.Random(8)
    words = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    passages = [words(n) for n in (50, 52, 60, 90, 400, 49)]
    texts = [" ".join(words(150)) for _ in range(4)]
    for k in range(40):
        p = passages[k % 6]
        lines = [words(rng.randrange(0, 30)), words(rng.randrange(60, 400)) + p + words(rng.randrange(60, 400))]
        if k % 3 == 0:
            lines[1] += passages[3][20:] + words(40)
        texts.append("\n".join(" ".join(x) for x in lines))
    texts.append(" ".join(words(30) + ["um"] * 300 + words(30)))  # repeats itself
    # near the ends of a line, and a line that is wholly part of a longer one
    texts += [" ".join(passages[1] + words(200)), " ".join(words(200) + passages[1]), " ".join(passages[4][100:180])]
    df = frame(texts)
    repeats = P.find_repeats(df)
    check_left(df, texts, repeats)
    rows = repeats.collect()
    gone = [r for r in rows if r["removed"]]
    assert gone and all((r["kept_doc_id"], r["kept_first_word"]) < (r["doc_id"], r["first_word"]) for r in gone)
    assert not [r for r in rows if r["doc_id"] < 4]
    for r in rows:  # the line of the first word
        lines = texts[r["doc_id"]].split("\n")
        ends = np.cumsum([len(x.split()) for x in lines])
        assert r["paragraph"] == int(np.searchsorted(ends, r["first_word"], "right"))


def test_passages_over_line_breaks(frame):
    rng = random.Random(9)
    words = lambda n: [f"z{rng.randrange(9000)}" for _ in range(n)]

    def wrapped(w, least, most):
        out, at = [], 0
        while at < len(w):
            n = rng.randrange(least, most + 1)
            out.append(" ".join(w[at : at + n]))
            at += n
        return "\n".join(out)

    passage = words(60)
    kinds = [
        lambda: wrapped(words(70) + passage + words(55), 10, 40),  # a line of other length in every copy
        lambda: wrapped(words(30), 15, 15) + "\n" + wrapped(passage, 15, 15) + "\n\n" + " ".join(words(80)),
        lambda: " ".join(words(40)) + "\n" + " ".join(words(100) + passage + words(90)),
        lambda: " ".join(words(300)) + "\n" + "\n \n".join(passage),
    ]
    texts = [k() for k in kinds for _ in range(10)] + [wrapped(words(200), 5, 60) for _ in range(10)]
    df = frame(texts)
    rows = P.find_repeats(df).collect()
    assert {r["doc_id"] for r in rows} == set(range(40))
    assert {r["doc_id"] for r in rows if r["removed"]} == set(range(1, 40))
    check_left(df, texts, P.find_repeats(df))


def test_a_repeating_line_is_one_passage(frame):
    texts = ["uh " * 3000, "a b c " * 200 + "\n" + "a b c " * 150, "um um um " * 5]
    df = frame(texts)
    assert P.find_repeats(df).collect() == []  # inside one document alone
    repeats = P.find_repeats(df, within=True)
    rows = repeats.collect()
    assert len(rows) <= 6 and {r["doc_id"] for r in rows} == {0, 1}
    check_left(df, texts, repeats, within=True)
    texts += ["uh " * 1000, "a " + "uh " * 400 + "b"]
    repeats = P.find_repeats(frame(texts))
    assert {r["doc_id"] for r in repeats.collect()} == {0, 3, 4}
    check_left(frame(texts), texts, repeats)


def test_words_and_paragraphs():
    rng = random.Random(4)
    texts = ["\n".join(" ".join("w" * rng.randrange(1, 3) for _ in range(rng.choice([0, 3, 9, 20]))) for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    for least in (1, 4, 10, 25):
        words = P.Words(texts)
        own, start, size = words.paragraphs(least)
        got = [(int(o), int(s - words.text[o]), int(n)) for o, s, n in zip(own, start, size)]
        assert got == [(i, at, len(w)) for i, t in enumerate(texts) for at, w in units(t, least)]
        sh, many = words.sets(start, size)
        names = P.digests(sh, many).tolist()
        flat = [w for t in texts for _, w in units(t, least)]
        assert len({*zip(names, flat)}) == len(set(names)) == len(set(flat))
        sets = [set(x.tolist()) for x in np.split(sh, np.cumsum(many)[:-1])]
        assert [len(x) for x in sets] == [len({w[i : i + 5] for i in range(max(1, len(w) - 4))}) for w in flat]


def test_run_hashes_and_picks():
    w = [f"x{i % 37}" for i in range(200)]
    own = P.Words([" ".join(w)]).hash
    for n in (1, 16, 37, 50):
        h = P.run_hashes(own, n)
        assert len(h) == 200 - n + 1
        same = [[w[i : i + n] == w[j : j + n] for j in range(len(h))] for i in range(len(h))]
        assert (np.equal.outer(h, h) == np.array(same)).all()
    rng = np.random.default_rng(1)
    for h in (P.run_hashes(own, 16), rng.integers(0, 9, 185).astype(np.uint64), rng.integers(0, 1 << 62, 185).astype(np.uint64)):
        at = P.picked(h, 35)
        assert at.tolist() == sorted({int(k) for s in range(len(h) - 34) for k in s + np.flatnonzero(h[s : s + 35] == h[s : s + 35].min())})
