"""Document fingerprints from closed syncmers.

A text is a sequence of tokens: its white-space separated words, where a word of more than ``WORD`` code points
(scripts without spaces, encoded or minified text) is cut into pieces of about five.  A cut depends on the six
code points around it alone.  Texts below ``SHORT`` code points have anchors over their characters as well; they
count in a likeness only where both texts have them.  Each ``K`` neighbouring tokens contain ``K - S + 1`` runs of ``S`` tokens; the
``K`` tokens are a closed syncmer, an anchor, when the smallest hash among those runs is that of the first or
the last run.  Whether ``K`` tokens are an anchor depends on them alone, so an insertion or a cut elsewhere
moves no anchor, and equal passages have equal anchors wherever they stand.  About 2 in ``K - S + 1`` are.

The fingerprint lists the anchors' 32-bit hashes in text order, eight hexadecimal digits each; likeness is
the Jaccard coefficient of the sets of anchors.  DataFrame functions only, on arrays inside a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 6
S = 2
SHORT = 256
WORD = 16
GROUP = 256       # documents that look up their successor together


def _anchors(df: DataFrame, tokens: str, out: str) -> DataFrame:
    """Column ``out``: array<struct<pos, hash>> of the anchors of the token hashes in column ``tokens`` (null: none).

    A sequence shorter than K is one anchor.  Steps are columns of their own, so each is computed once.
    """
    runs = f"__{out}_runs"
    n = F.size(tokens)
    df = df.withColumn(runs, F.zip_with(F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(tokens, F.lit(2), n),
                                        lambda a, b: F.xxhash64(a, b)))

    def closed(i: Column) -> Column:
        run = [F.get(F.col(runs), i + j) for j in range(K - S + 1)]
        return F.least(run[0], run[-1]) <= F.least(*run[1:-1])

    def named(i: Column) -> Column:
        h = F.xxhash64(*[F.get(F.col(tokens), i + j) for j in range(K)])
        return F.struct(i.alias("pos"), h.bitwiseAND(F.lit(0xFFFFFFFF)).alias("hash"))
    at = F.filter(F.sequence(F.lit(0), n - K), closed)
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(tokens).bitwiseAND(F.lit(0xFFFFFFFF)).alias("hash")))
    found = F.when(F.col(tokens).isNull(), F.slice(whole, 1, 0)).when(n >= K, F.transform(at, named)).otherwise(whole)
    return df.withColumn(out, found).drop(runs)


def _bind(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pieces(word: Column) -> Column:
    """Hashes of a long word's pieces, cut where the hash of two neighbouring code points is below the two on each side."""
    def cut_up(c: Column, h: Column) -> Column:
        def low(i: Column) -> Column:
            return F.get(h, i) < F.least(*[F.get(h, i + d) for d in (-2, -1, 1, 2)])

        def named(cut: Column) -> Column:
            ends = F.concat(cut, F.array(F.size(c)))
            starts = F.concat(F.array(F.lit(0)), cut)
            return F.zip_with(starts, ends, lambda s, e: F.xxhash64(F.array_join(F.slice(c, s + 1, e - s), "")))
        return _bind(F.filter(F.sequence(F.lit(2), F.size(h) - 3), low), named)
    return _bind(F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0)), lambda c: _bind(
        F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c)), lambda x, y: F.xxhash64(x, y)),
        lambda h: cut_up(c, h)))


def with_anchors(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with the column ``out``: array<struct<pos, hash, char>>, the anchors of a text that is not null.

    ``pos`` is the first token's number, among words first, then among characters for texts below ``SHORT``.
    """
    words, chars = f"__{out}_w", f"__{out}_c"
    split = F.filter(F.split(F.col(text_col), r"\s+"), lambda w: w != "")
    tokens = F.flatten(F.transform(split, lambda w: F.when(F.length(w) > WORD, _pieces(w)).otherwise(F.array(F.xxhash64(w)))))
    df = df.withColumn(words, F.when(F.col(text_col).rlike(rf"\S{{{WORD + 1}}}"), tokens)
                       .otherwise(F.transform(split, lambda w: F.xxhash64(w))))
    df = df.withColumn(chars, F.when(F.length(text_col) < SHORT,
                                     F.transform(F.split(F.col(text_col), ""), lambda c: F.xxhash64(c, F.lit(1)))))
    df = _anchors(_anchors(df, words, f"{words}a"), chars, f"{chars}a")
    def marked(found: str, char: bool) -> Column:
        return F.transform(found, lambda x: F.struct(x["pos"].alias("pos"), x["hash"].alias("hash"), F.lit(char).alias("char")))
    both = marked(f"{words}a", False), marked(f"{chars}a", True)
    return df.withColumn(out, F.concat(*both)).drop(words, chars, f"{words}a", f"{chars}a")


def fingerprint(anchors: Column) -> Column:
    """Hashes in text order, eight hexadecimal digits each."""
    digits = F.transform(anchors["hash"], lambda h: F.substring(F.hex(h + F.lit(1 << 32)), 2, 8))
    return F.lower(F.array_join(digits, ""))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two anchor sets, 0 to 1; without the characters' anchors where one text has none."""
    def has(x: Column) -> Column:
        return F.exists(x, lambda y: y["char"])

    def hashes(x: Column) -> Column:
        return F.when(has(a) == has(b), x["hash"]).otherwise(F.filter(x, lambda y: ~y["char"])["hash"])
    return F.size(F.array_intersect(hashes(a), hashes(b))) / F.size(F.array_union(hashes(a), hashes(b)))


def successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, a, next, b): each document with its anchors and those of the next by id (the last one's is the first).

    Documents are grouped by ranges of ids, ``GROUP`` to a group on average, and look up their successor inside
    it; a group's last document takes the first one of the next group that is not empty, found over a table of
    one row a group in two levels.  Rows with equal ids follow each other by text.  A row without an id has no
    place in the order; its successor is an empty text.  Null texts count as empty.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    low, high, n = src.agg(F.min("id"), F.max("id"), F.count("id")).first()
    none = with_anchors(src.where("id is null").withColumn("next", F.lit("")), "text", "a")
    none = with_anchors(none, "next", "b").select("id", "text", "a", "next", "b")
    if not n:
        return none
    width = max(1, (high - low + 1) * GROUP // n)
    placed = src.where("id is not null").withColumn("g", F.floor((F.col("id").cast("double") - float(low)) / width)).where("g is not null")
    grouped = placed.repartition("g")           # the one shuffle of the texts; anchors are computed behind it
    w = Window.partitionBy("g").orderBy("id", "text")
    inner = with_anchors(grouped, "text", "a")
    inner = (inner.withColumn("next", F.lead("text").over(w)).withColumn("b", F.lead("a").over(w)).where("next is not null")
             .select("id", "text", "a", "next", "b"))
    heads = grouped.withColumn("x", F.lag("id").over(w)).where("x is null").select("g", F.col("text").alias("next"))
    tails = grouped.withColumn("x", F.lead("id").over(w)).where("x is null").select("g", "id", "text")
    have = placed.select("g").distinct().withColumn("s", F.floor(F.col("g") / 4096))
    tops = have.groupBy("s").agg(F.min("g").alias("top"))
    tops = tops.withColumn("then", F.coalesce(F.lead("top").over(Window.orderBy("s")), F.min("top").over(Window.partitionBy())))
    after = have.withColumn("near", F.lead("g").over(Window.partitionBy("s").orderBy("g"))).join(tops, "s")
    after = after.select("g", F.coalesce("near", "then").alias("then"))
    outer = tails.join(after, "g").join(heads.withColumnRenamed("g", "then"), "then").select("id", "text", "next")
    outer = with_anchors(with_anchors(outer, "text", "a"), "next", "b").select("id", "text", "a", "next", "b")
    return inner.unionByName(outer).unionByName(none)


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter (rounded down) replaced by as many first code points of the next one."""
    n = F.length(text)
    m = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - m), F.substring(following, F.lit(1), m))


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) per document row."""
    rows = successors(docs, id_col, text_col).withColumn("edited", edited(F.col("text"), F.col("next")))
    rows = with_anchors(rows, "edited", "e")
    a, b, e = F.col("a"), F.col("b"), F.col("e")
    return rows.select("id", F.length("text").cast("long").alias("n_chars"), "edited", fingerprint(a).alias("fingerprint"),
                       fingerprint(e).alias("edited_fingerprint"), likeness(a, e).alias("near_edited"),
                       likeness(a, b).alias("near_next"))
