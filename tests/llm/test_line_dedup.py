"""Fuzzy line de-duplication against brute force over all pairs of lines."""

import itertools
import random

from codeloom.llm import line_dedup as L


def brute(rows, sim=0.8):
    lines = {}
    for k, t in rows:
        for pos, ln in enumerate((t or "").split("\n")):
            if ln.strip():
                lines.setdefault(ln, []).append((L.NO_ID if k is None else k, pos))
    texts = list(lines)
    sets = [{t[i:i + 5] for i in range(len(t) - 4)} or {t} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(range(len(texts)), 2):
        i = len(sets[a] & sets[b])
        if i / (len(sets[a]) + len(sets[b]) - i) >= sim:
            root[find(a)] = find(b)
    first = {}
    for i, t in enumerate(texts):
        r = find(i)
        first[r] = min(([first[r]] if r in first else []) + lines[t])
    gone = {(k, p) for i, t in enumerate(texts) for k, p in lines[t] if (k, p) != first[find(i)]}
    out = []
    for k, t in rows:
        ls = (t or "").split("\n")
        kk = L.NO_ID if k is None else k
        keep = [x for p, x in enumerate(ls) if (kk, p) not in gone]
        out.append((k, "\n".join(keep), len(ls), len(ls) - len(keep)))
    return out


def make_rows(n=40, seed=8):
    rnd = random.Random(seed)
    vocab = [f"{rnd.choice(['th', 'er', 'on', 'é', 'st'])}{rnd.randrange(999)}" for _ in range(300)]
    line = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    pool = [line(rnd.randint(3, 60)) for _ in range(25)]

    def variant(x):
        w = x.split(" ")
        if rnd.random() < .6:
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        return " ".join(w)
    rows = []
    for i in range(n):
        ls = [variant(rnd.choice(pool)) if rnd.random() < .5 else line(rnd.randint(1, 40)) for _ in range(rnd.randint(0, 8))]
        ls += ["", "  ", "ok"][:rnd.randint(0, 3)]
        rnd.shuffle(ls)
        rows.append((i * 7 % 101, "\n".join(ls)))
    return rows + [(500, None), (501, ""), (502, "\n\n"), (None, rows[1][1]), (503, line(5000) + "\n" + rows[2][1])]


def test_against_brute_force(spark):
    rows = make_rows()
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, lid int, gone string")
    out = L.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "lid", "gone", "n_lines", "n_removed"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_hot_bucket_and_empty(spark):
    base = " ".join(f"word{i}" for i in range(50))
    rows = [(i, base.replace("word7 ", f"other{i} ") if i else base) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.dedup_lines(df).collect()}
    assert got[0] == base and all(got[i] == "" for i in range(1, 60))
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_repeated_rows_are_one_document(spark):
    df = spark.createDataFrame([(1, "a long enough line\nb"), (1, "a long enough line\nb"), (2, "a long enough line")],
                               "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in L.dedup_lines(df).collect()) == [
        (1, "a long enough line\nb"), (1, "a long enough line\nb"), (2, "")]


def test_long_repetitive_and_short_lines(spark):
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(3 * L.SLAB + 17))
    rows = [(1, long), (2, long[:100] + "#" + long[100:]), (3, "-----\nab\nabcdefgh"), (4, "-" * 40 + "\nab\nabcdefghi"),
            (5, "abc\nabcd"), (6, "日本語の行です。とても長い行ですよ"), (7, "日本語の行です。とても長い行ですよ!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in L.dedup_lines(df).collect())
    assert got == sorted(brute(rows))
    assert [r[1] for r in got] == [long, "", "-----\nab\nabcdefgh", "", "abc\nabcd", rows[5][1], ""]


def test_signatures_follow_the_similarity():
    rnd = random.Random(6)
    near, agree = [], []
    for _ in range(1500):
        a = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(rnd.randint(30, 400)))
        b = list(a)
        for _ in range(max(1, len(a) // 50 + rnd.randint(-1, 1))):
            b[rnd.randrange(len(b))] = "#"
        b = "".join(b)
        j, = L.jaccards([a, b], [(0, 1)])
        x, y = ({t[i:i + 5] for i in range(len(t) - 4)} for t in (a, b))
        assert j == len(x & y) / len(x | y)
        s = L.signatures([a, b])
        agree.append((s[0] == s[1]).mean() - j)
        if j >= 0.8:
            keys = L.band_keys(s)
            near.append((keys[0] == keys[1]).any())
    assert abs(sum(agree) / len(agree)) < 0.01
    assert len(near) > 300 and sum(near) >= 0.99 * len(near)


def test_slabs_do_not_change_a_signature(monkeypatch):
    rnd = random.Random(7)
    lines = ["", "a", "a" * 9] + ["".join(rnd.choice("abcdé日 ") for _ in range(n)) for n in (4, 5, 6, 70, 1000, 5000)]
    whole = L.signatures(lines)
    monkeypatch.setattr(L, "SLAB", 64)
    assert (L.signatures(lines) == whole).all()


def test_families_in_one_bucket(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(7))
    shared = [word() for _ in range(60)]
    rows = []
    for f in range(40):
        own = [word() for _ in range(30)]
        for v in range(3):
            w = shared + own
            w[rnd.randrange(len(w))] = word()
            rows.append((f * 10 + v, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in L.dedup_lines(df).collect())
    assert got == sorted(brute(rows))


def test_prunes_keep_every_near_pair(spark):
    rnd = random.Random(11)
    part = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    rows = []
    for i in range(12):
        # one edit in a repeated phrase makes many new windows of 16 characters and few of 5
        phrase = " ".join(part(2) for _ in range(30))
        rows += [(i * 10, " ".join([phrase] * 5)), (i * 10 + 1, " ".join([phrase] * 4 + [phrase[:40] + "#" + phrase[41:]]))]
        # few words: the second line has one more space, so it lies on the other side of one word in 40 characters
        blob = part(400)
        rows += [(i * 10 + 2, " ".join([blob[:300], *[blob[300 + j * 10:310 + j * 10] for j in range(9)], blob[390:]])),
                 (i * 10 + 3, " ".join([blob[:300], *[blob[300 + j * 10:310 + j * 10] for j in range(8)], blob[380:]]))]
        # long words, each with one letter changed
        words = [part(70) for _ in range(12)]
        rows += [(i * 10 + 4, " ".join(words)), (i * 10 + 5, " ".join(w[:35] + "#" + w[36:] for w in words))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in L.dedup_lines(df).collect())
    assert got == sorted(brute(rows))
    assert sum(r[3] for r in got) == 36


def test_sketches_never_differ_more_than_the_sets():
    rnd = random.Random(12)
    for n in (1, 4, 5, 30, 400, 3000):
        a = "".join(rnd.choice("abcdef ") for _ in range(n))
        b = "".join(rnd.choice("abcdef#") if rnd.random() < .05 else c for c in a) + rnd.choice(["", "zz"])
        x, y = ({t[i:i + 5] for i in range(len(t) - 4)} or {t} for t in (a, b))
        size, words = L.sketches([a, b])
        assert list(size) == [len(x), len(y)] and words.shape == (2, L.SKETCH // 64)
        differ = sum(int(v).bit_count() for v in (words[0] ^ words[1]).view("uint64"))
        assert differ <= len(x ^ y) and (differ - len(x ^ y)) % 2 == 0


def test_family_just_below_the_threshold_is_not_paired(spark, monkeypatch):
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(7))
    shared = [word() for _ in range(60)]
    rows = [(i, " ".join(shared + [word() for _ in range(12)])) for i in range(80)]        # two of them at 0.70 or so
    rows += [(200 + i, t.replace(shared[5], "changed")) for i, t in rows[:10]]
    seen, was = [], L.verified

    def counted(pairs, text, similarity):
        seen.append(pairs.count())
        return was(pairs, text, similarity)
    monkeypatch.setattr(L, "verified", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in L.dedup_lines(df).collect())
    assert got == sorted(brute(rows)) and sum(r[3] for r in got) == 10
    assert sum(seen) < 1000                     # all pairs: 4,005


def test_second_verification_reads_only_the_lines_its_pairs_name(spark, monkeypatch):
    rnd = random.Random(14)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(7))
    shared = [word() for _ in range(60)]
    rows = [(i, " ".join(shared + [word() for _ in range(12)])) for i in range(40)]
    rows += [(200 + i, t.replace(shared[5], "changed")) for i, t in rows[:6]]
    seen, was = [], L.verified

    def counted(pairs, text, similarity):
        seen.append((pairs.count(), text.count()))
        return was(pairs, text, similarity)
    monkeypatch.setattr(L, "verified", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in L.dedup_lines(df).collect())
    assert got == sorted(brute(rows)) and sum(r[3] for r in got) == 6
    (first, lines), (rest, few) = seen
    assert first and lines > 2 * rest and few <= 2 * rest


def test_documents_that_lose_lines_are_not_broadcast(spark):
    df = spark.createDataFrame([(i, f"a line that all documents have\nline {i}") for i in range(20)], "doc_id long, text string")
    out = L.dedup_lines(df)
    joins = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x and "__k" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)
    assert sum(r.n_removed for r in out.collect()) == 19
