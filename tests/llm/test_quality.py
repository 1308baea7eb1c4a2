import re
from collections import Counter

from portolan.llm import quality
from portolan.llm.common import table


def expected(rows, max_docs, max_share, min_left):
    """Plain Python for ``assess``."""
    space = re.compile(r"[\x20\x09-\x0D]+")
    normal = lambda line: space.sub(" ", line.lower()).strip(" ")
    holders, hosts = {}, {}
    for _, text, host in rows:
        hosts.setdefault(host, set()).add(text)
        for line in (text or "").split("\n"):
            if normal(line):
                holders.setdefault((host, normal(line)), set()).add(text)
    bad = {k for k, v in holders.items() if len(v) > max_docs and len(v) > max_share * len(hosts[k[0]])}
    out = []
    for doc_id, text, host in rows:
        text = text or ""
        words = [w for w in space.split(text) if w]
        windows = Counter(zip(words, words[1:], words[2:]))
        hit = set()
        for i in range(len(words) - 2):
            if windows[tuple(words[i : i + 3])] > 1:
                hit |= {i, i + 1, i + 2}
        lines = [line for line in text.split("\n") if normal(line)]
        lost = sum(len(normal(line).split(" ")) for line in lines if (host, normal(line)) in bad)
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        kept = not failed and not (lost > 0 and len(words) - lost < min_left)
        out.append((doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed, lost, kept))
    return out


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost_words", "kept"]


def got(df):
    return sorted([tuple(r[c] for c in NAMES) for r in df.collect()], key=repr)


def test_equals_brute_force_on_the_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    for limits in ((50, 0.005, 20), (1, 0.0, 100)):
        assert got(quality.assess(docs, *limits)) == sorted(expected(rows, *limits), key=repr)


def test_odd_rows(documents):
    notice = "Menu  Home\tContact"
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{notice}\n{body} {i}", "a") for i in range(4)]
    rows += [(10, f"menu home contact\n{' '.join('s%d' % i for i in range(47))}", "a")]
    rows += [(20, None, None), (21, "", "a"), (None, "a b c a b c", "b"), (22, "\x0b\x0c \r\n \n", "b"), (23, "x y x y x y x", None)]
    rows += [(0, rows[0][1], "a"), (30, "same " * 20000, "c"), (31, "é ü " * 60 + " |#", "c"), (24, "MENU HOME CONTACT", None)]
    df = documents(rows, extra=("page", "line", "kept", "host", "figures", "gone"))
    assert got(quality.assess(df, 3, 0.0, 48)) == sorted(expected(rows, 3, 0.0, 48), key=repr)
    assert [r.kept for r in quality.assess(df, 3, 0.0, 48).filter("doc_id = 10").collect()] == [False]  # 47 words left
    assert quality.assess(df.limit(0)).count() == 0


def test_apply_rules_removes_lines_and_documents(documents):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"Home | Contact\n{body} {i}\n", "a") for i in range(5)] + [(9, "short", "a"), (5, f"Home | Contact\n{body}", "b")]
    df = documents(rows, extra=("page", "row"))
    out = {r.doc_id: r for r in quality.apply_rules(df, 3, 0.0, 20).collect()}
    assert sorted(out) == [0, 1, 2, 3, 4, 5]
    assert out[0].text == f"{body} 0\n" and out[0].n_chars == len(out[0].text)
    assert out[5].text == rows[-1][1]  # another host
    assert quality.apply_rules(df).columns == df.columns


def test_plan_has_no_python(spark, sf_dir):
    plan = quality.assess(table(spark, sf_dir, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
