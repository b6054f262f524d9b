"""Near duplicates against brute force; sources S1, S3, S4; registry contract."""

import itertools
import os

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import dup as D
from codeloom.sources import corpus as CO

DOCS = [
    (1, "the quick brown fox jumps over the lazy dog again and again"),
    (2, "the quick brown fox jumps over the lazy dog again and again today"),
    (3, "a completely different text about spark joins and shuffles"),
    (4, "a completely different text about spark joins and shuffles"),
    (5, "short"),
]


def shingle_set(text, k=3):
    import re
    toks = [t for t in re.split(r"[^\w]+", text.lower()) if t]
    if len(toks) < k:
        return {" ".join(toks)}
    return {" ".join(toks[i:i + k]) for i in range(len(toks) - k + 1)}


def test_near_duplicates_equal_brute_force(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = {(r.doc_a, r.doc_b): r.jaccard for r in D.near_duplicates(df, threshold=0.7).collect()}
    truth = {}
    for (a, ta), (b, tb) in itertools.combinations(DOCS, 2):
        sa, sb = shingle_set(ta), shingle_set(tb)
        j = len(sa & sb) / len(sa | sb)
        if j >= 0.7:
            truth[(min(a, b), max(a, b))] = j
    assert set(got) == set(truth)       # its only copies are one pair
    for k, v in got.items():
        assert abs(v - truth[k]) < 1e-9
    assert (3, 4) in got and (1, 2) in got


def test_texts_of_one_id_are_one_set_of_shingles(spark):
    one, two = " ".join(f"a{i}" for i in range(10)), " ".join(f"b{i}" for i in range(10))
    df = spark.createDataFrame([(1, one), (1, two), (1, two), (2, f"{one} {two}"), (3, None), (4, "!")], "doc_id long, text string")
    got = [(r.doc_a, r.doc_b, round(r.jaccard, 9)) for r in D.near_duplicates(df, threshold=0.7).collect() if r.jaccard < 1]
    assert got == [(1, 2, round(16 / 18, 9))]


def test_near_duplicates_cut_each_text_once(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    plan = D.near_duplicates(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan         # words are read from the stored sets, not cut again by each join
    sets = D.shingles(df, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in sets and "Join" not in sets


def test_shingles_are_counted_without_a_row_for_each(spark, monkeypatch):
    import random
    from collections import Counter
    monkeypatch.setattr(D, "CUT_TEXTS", 3)
    monkeypatch.setattr(D, "PART_SHINGLES", 50)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["Ärger", "ñu", "naïve"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 3, 30, 60])))) for i in range(60)]
    for i in range(20):                                                       # near copies: a word more, or one changed
        w = docs[i][1].split()
        docs.append((100 + i, " ".join([*w, "end"] if i % 2 else ["w0", *w[1:]])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    sets = D.shingle_sets(df, "doc_id", "text")
    want = {i: shingle_set(t) - {""} for i, t in docs}
    assert {r.doc: len(r.shs) for r in sets.collect()} == {i: len(s) for i, s in want.items() if s}
    assert "Generate" not in D._shared(sets.withColumn("n", F.size("shs")))._jdf.queryExecution().optimizedPlan().toString()
    count = Counter(x for s in want.values() for x in s)
    got = D._shared(sets.withColumn("n", F.size("shs"))).groupBy("doc").agg(F.count("*").alias("n"), F.sum("df").alias("df")).collect()
    assert {(r.doc, r.n, r.df) for r in got} == {(i, sum(count[x] > 1 for x in s), sum(count[x] for x in s if count[x] > 1))
                                                 for i, s in want.items() if any(count[x] > 1 for x in s)}
    first = {}
    for i, t in docs:
        first.setdefault(t, i)
    truth = {(a, b): len(want[a] & want[b]) / len(want[a] | want[b]) for a, b in itertools.combinations(sorted(first.values()), 2) if want[a] & want[b]}
    truth = {p: j for p, j in truth.items() if j >= 0.7} | {(first[t], i): 1.0 for i, t in docs if first[t] != i}
    near = {(r.doc_a, r.doc_b): r.jaccard for r in D.near_duplicates(df).collect()}
    assert len(truth) > 8 and set(near) == set(truth) and all(abs(near[p] - truth[p]) < 1e-9 for p in truth)


def test_exact_duplicates(spark):
    files = spark.createDataFrame([("r", "a", False, "x"), ("s", "b", False, "x"), ("r", "c", False, "y")],
                                  "repository_id string, path string, binary boolean, content string")
    out = D.exact_duplicates(files).collect()
    assert len(out) == 1 and out[0].n_copies == 2 and out[0].n_repositories == 2


def test_raw_tree_keeps_underscore_files(spark, scratch):
    root = os.path.join(scratch, "repo")
    os.makedirs(os.path.join(root, "src"))
    for rel, data in [("src/__init__.py", b""), ("src/a.py", b"x = 1\n"), ("logo.png", b"\x89PNG"),
                      ("bad.txt", b"\xff\xfe\x00")]:
        with open(os.path.join(root, rel), "wb") as fh:
            fh.write(data)
    listing = spark.createDataFrame([("r", root, p) for p in ["src/__init__.py", "src/a.py", "logo.png", "bad.txt"]],
                                    "repository_id string, root string, path string")
    raw = CO.read_listed_files(spark, listing)
    files = CO.scan_files(raw, bytes_col="bytes")
    got = {r.path: (r.binary, r.content) for r in files.collect()}
    assert got["src/__init__.py"] == (False, "")
    assert got["src/a.py"] == (False, "x = 1\n")
    assert got["logo.png"][0] is True and got["bad.txt"][0] is True


def test_api_commit_payload(spark):
    import json
    payload = json.dumps({"sha": "abcdef1234", "commit": {"message": " fix \n", "author": {
        "name": "n", "email": "e@x", "date": "2023-01-01T12:00:00Z"}},
        "files": [{"filename": "a", "status": "added", "additions": 3, "deletions": 0},
                  {"filename": "b", "status": "removed", "additions": 0, "deletions": 2},
                  {"filename": "c", "status": "changed", "additions": 1, "deletions": 1}]})
    df = spark.createDataFrame([("r", payload)], "repository_id string, payload string")
    commits, changes = CO.read_api_commits(df)
    c = commits.first()
    assert (c.short_hash, c.author, c.message, c.files_changed, c.insertions, c.deletions) == (
        "abcdef1", "n <e@x>", "fix", 3, 4, 3)
    assert [r.change_type for r in changes.orderBy("path").collect()] == ["added", "deleted", "modified"]


def test_issue_events(spark):
    rows = [(1, "issues", (42, "Test Issue", "This is a test issue", ("testuser",), "2023-01-01T12:00:00"), None),
            (2, "issue_comment", (42, "Test Issue", "x", ("a",), "2023"),
             ("This is a test comment", ("testuser",), "2023-01-01T12:00:00")),
            (3, "push", None, None)]
    schema = ("event_id int, event_name string, "
              "issue struct<number:int,title:string,body:string,user:struct<login:string>,created_at:string>, "
              "comment struct<body:string,user:struct<login:string>,created_at:string>")
    out = {r.event_id: r for r in CO.read_issue_events(spark.createDataFrame(rows, schema)).collect()}
    assert set(out) == {1, 2}
    assert (out[1].title, out[1].body, out[1].author, out[1].number) == ("Test Issue", "This is a test issue", "testuser", 42)
    assert out[2].body == "This is a test comment"


def test_write_corpus_partitions(spark, scratch):
    df = spark.createDataFrame([("r1", "a"), ("r2", "b")], "repository_id string, path string")
    CO.write_corpus({"files": df}, scratch)
    parts = sorted(n for n in os.listdir(os.path.join(scratch, "files")) if n.startswith("repository_id="))
    assert parts == ["repository_id=r1", "repository_id=r2"]


def test_tokenize_unicode(spark):
    df = spark.createDataFrame([("Größe, naïve-test_x 42",)], "t string")
    toks = [t for t in df.select(T.tokenize(F.col("t"))).first()[0] if t]
    assert toks == ["größe", "naïve", "test_x", "42"]


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs) and len(qs) >= 50


def test_binary_bytes_and_name_status(spark):
    from codeloom.functions import exprs as X
    df = spark.createDataFrame([(bytearray(b"abc\x00def"),), (bytearray(b"plain text"),)], "b binary")
    assert [r[0] for r in df.select(X.is_binary_bytes(F.col("b"), 1024)).collect()] == [True, False]
    assert [r[0] for r in df.select(X.is_binary_bytes(F.col("b"), 3)).collect()] == [False, False]
    lines = spark.createDataFrame([("M\tsrc/a.py",), ("R100\told\tnew",), ("no tab",)], "l string")
    out = [r[0] for r in lines.select(X.parse_name_status(F.col("l"))).collect()]
    assert (out[0].status, out[0].path) == ("M", "src/a.py")
    assert (out[1].status, out[1].path) == ("R100", "old\tnew")
    assert out[2] is None


def test_read_commits_log(spark, scratch):
    import json
    rows = [{"repository_id": "r", "hash": "abc", "parents": [], "author_name": "n", "author_email": "e",
             "author_ts": "2024-01-01T00:00:00", "committer_ts": "2024-01-01T00:00:00", "message": " msg \n",
             "seq": 0, "file_changes": [{"path": "a.py", "change_type": "added", "insertions": 3, "deletions": 0,
                                         "parent_no": 0}]}]
    p = os.path.join(scratch, "log.jsonl")
    with open(p, "w") as fh:
        fh.write("\n".join(json.dumps(r) for r in rows))
    commits, changes = CO.read_commits(spark, p)
    assert commits.first().message == "msg"
    ch = changes.first()
    assert (ch.hash, ch.path, ch.insertions) == ("abc", "a.py", 3)


def test_to_context_json(spark):
    df = spark.createDataFrame([(1, "a", 2)], "query_id int, x string, y int")
    assert CO.to_context_json(df).first().context == '{"x":"a","y":2}'


def test_binary_file_reader_and_duplication_score(spark, scratch):
    root = os.path.join(scratch, "tree")
    os.makedirs(os.path.join(root, "src"))
    for rel, data in [("src/a.py", b"x = 1\n"), ("src/b.py", b"x = 1\n"), ("c.txt", b"one\ntwo\n")]:
        with open(os.path.join(root, rel), "wb") as fh:
            fh.write(data)
    raw = CO.read_raw_tree(spark, root, "r")
    files = CO.scan_files(raw, bytes_col="bytes")
    got = {r.path: r.content for r in files.collect()}
    assert got == {"src/a.py": "x = 1\n", "src/b.py": "x = 1\n", "c.txt": "one\ntwo\n"}
    score = D.duplication_score(files).first().code_duplication
    assert abs(score - 50.0) < 1e-9  # 2 of 4 lines sit in files that have an exact copy
