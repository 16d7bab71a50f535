import hashlib
import re

from lenswright.llm import decontaminate

from . import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        for k in range(len(w) - n + 1) if n else ():
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    for i, t, *_ in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= {str(j) for j in wins[x] if j is not None}
        yield str((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))


def _docs():
    rows = cases.documents()
    passage = " ".join(f"quiz{k}" for k in range(25))
    rows += [(400, f"before it {passage} after it", "en", "s", 1), (401, passage.upper().replace(" ", " -- "), "en", "s", 1), (402, " ".join(passage.split()[3:12]), "en", "s", 1), (403, "answer forty two " * 5, "en", "s", 1)]
    rows += [(404, "À la carte É " + passage, "en", "s", 1)] * 2
    items = [(1, passage), (2, " ".join(passage.split()[5:16])), (10, "forty Two"), (11, "..."), (12, None), (12, passage + " more"), (None, "carte É quiz0")]
    return rows, items


def test_like_brute_force(spark):
    rows, items = _docs()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(cases.clashing(cases.frame(spark, rows)), bench).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(brute(rows, items))


def test_only_clean_documents_stay(spark):
    rows, items = _docs()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = cases.clashing(cases.frame(spark, rows))
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    clean = sorted(str((i, t)) for (i, t, *_), r in zip(rows, brute(rows, items)) if r.endswith("False)"))
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == clean


def test_empty_tables(spark):
    rows, items = _docs()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.digest(cases.frame(spark, []), bench).collect() == []
    assert {r.contaminated for r in decontaminate.digest(cases.frame(spark, rows), bench.limit(0)).collect()} == {False}


def test_no_python_on_the_main_path(spark):
    rows, items = _docs()
    df = decontaminate.digest(cases.frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
