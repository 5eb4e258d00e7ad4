"""Site-relative line counts against plain Python."""

from collections import Counter, defaultdict

from tallyfield.llm import site_lines as S

TEXTS = (
    [f"Menu\nbody {i}\n \nFoot  " for i in range(12)] + [None, "", "\n\n", "Menu", "Menu\nMenu\nMenu", "x" * 100_000]
    + ["only here\nMenu"] * 4
)
HOSTS = ["a"] * 12 + ["a", "a", "b", "b", "b", "b"] + [None, "c", "c", None]


def brute(texts, hosts, ratio, least):
    pages, seen = Counter(hosts), defaultdict(Counter)
    for t, h in zip(texts, hosts):
        for line in {x.strip(" ") for x in (t or "").split("\n")} - {""}:
            seen[h][line] += 1
    out = []
    for t, h in zip(texts, hosts):
        if t is None:
            out.append((None, 0, 0))
            continue
        lines = t.split("\n")
        gone = set() if h is None else {x for x, n in seen[h].items() if n >= least and n / pages[h] > ratio}
        kept = [x for x in lines if x.strip(" ") not in gone]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def got(df):
    return [(r["text"], r["n_lines"], r["n_dropped"]) for r in df.orderBy("doc_id").collect()]


def test_against_brute_force(frame, monkeypatch):
    df = frame(TEXTS, sources=HOSTS)
    for ratio, least in ((0.1, 5), (0.5, 1), (0.0, 1), (1.0, 1)):
        want = brute(TEXTS, HOSTS, ratio, least)
        assert got(S.drop_site_lines(df, "source", "text", ratio, least)) == want
    monkeypatch.setattr(S, "BROADCAST_LINES", -1)  # the salted join
    assert got(S.drop_site_lines(df, "source", "text", 0.1, 2)) == brute(TEXTS, HOSTS, 0.1, 2)


def test_columns_and_empty_table(frame):
    df = frame(["a"])
    assert S.drop_site_lines(df, "source", "text").columns == [*df.columns, "n_lines", "n_dropped"]
    assert S.drop_site_lines(df.limit(0), "source", "text").collect() == []


def test_no_python_in_the_plan(frame):
    plan = S.drop_site_lines(frame(TEXTS, sources=HOSTS), "source", "text")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
