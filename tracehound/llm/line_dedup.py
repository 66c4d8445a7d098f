"""Removal of passages that repeat: windows of three consecutive lines, found by hash over all documents.

Of all places where a window of lines stands, the first (by doc_id, then position) stays; the lines that the later
places cover are removed. Windows overlap, so a repeated passage of any length from three lines on goes as a whole.
Where long_words is given, fewer lines are a passage too if they have more words than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import word_count
from .shared import staged, text_or_empty

WINDOW_LINES = 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _parts(docs: DataFrame, counted: bool) -> DataFrame:
    """(doc_id, tie, parts): two hashes of each line, cut of white space around it, whether it is blank, and its words
    where these are counted.

    Lines are hashed here, once each: inside the lambda of a window they would be hashed again for every window.
    """
    text = text_or_empty()
    cut = lambda line: F.trim(line)
    words = lambda line: word_count(line) if counted else F.lit(0).cast("long")
    part = lambda line: F.struct(F.xxhash64(cut(line), F.lit(1)).alias("h1"), F.xxhash64(cut(line), F.lit(2)).alias("h2"), (cut(line) == "").alias("blank"), words(line).alias("words"))
    return docs.select("doc_id", F.xxhash64(text, F.lit(3)).alias("tie"), F.transform(lines_of(text), part).alias("parts"))


def _windows(n: int) -> Column:
    """(pos, n, h1, h2, blank, words) of each n consecutive members of parts: n shifted copies side by side, so the work
    is linear in the lines."""
    size = F.greatest(F.size("parts") - (n - 1), F.lit(0))
    beside = F.arrays_zip(*[F.slice("parts", k + 1, size).alias(f"p{k}") for k in range(n)])

    def one(z: Column, pos: Column) -> Column:
        own = [z[f"p{k}"] for k in range(n)]
        hashes = [F.xxhash64(*[p[h] for p in own], F.lit(seed)).alias(h) for seed, h in enumerate(("h1", "h2"), 1)]
        blank, words = own[0]["blank"], own[0]["words"]
        for p in own[1:]:
            blank, words = blank & p["blank"], words + p["words"]
        return F.struct(pos.alias("pos"), F.lit(n).alias("n"), *hashes, blank.alias("blank"), words.alias("words"))

    return F.transform(beside, one)


def find_windows(docs: DataFrame, width: int = WINDOW_LINES, long_words: int | None = None) -> DataFrame:
    """(doc_id, tie, pos, n, h1, h2): each window of each document by its first line's position; with long_words also each
    n < width consecutive lines of over long_words words."""
    found = [F.filter(_windows(width), lambda w: ~w["blank"])]
    if long_words is not None:
        found += [F.filter(_windows(n), lambda w: w["words"] > long_words) for n in range(1, width)]
    rows = _parts(docs, long_words is not None).select("doc_id", "tie", F.explode(F.concat(*found)).alias("w"))
    return rows.select("doc_id", "tie", "w.pos", "w.n", "w.h1", "w.h2")


def covered_lines(docs: DataFrame, width: int = WINDOW_LINES, long_words: int | None = None) -> DataFrame:
    """(doc_id, tie, removed): the positions that later occurrences of repeated windows cover, for documents with any."""
    windows = staged(find_windows(docs, width, long_words), "line-windows")
    place = F.struct("doc_id", "tie", "pos")
    # The same row twice is one document: a window repeats if it stands at two different places.
    first = windows.groupBy("n", "h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = staged(first.filter(F.col("first") != F.col("last")).select("n", "h1", "h2", F.col("first.doc_id").alias("first_doc"), F.col("first.tie").alias("first_tie"), F.col("first.pos").alias("first_pos")), "line-first")
    same_doc = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("tie") == F.col("first_tie"))
    later = windows.join(first, ["n", "h1", "h2"]).filter(~(same_doc & (F.col("pos") == F.col("first_pos"))))
    # Where a window overlaps its own first occurrence, the first stays whole.
    begin = F.when(same_doc, F.greatest("pos", F.col("first_pos") + F.col("n"))).otherwise(F.col("pos"))
    cover = later.select("doc_id", "tie", F.explode(F.sequence(begin, F.col("pos") + F.col("n") - 1)).alias("line"))
    return cover.groupBy("doc_id", "tie").agg(F.collect_set("line").alias("removed"))


def dedup_lines(docs: DataFrame, width: int = WINDOW_LINES, long_words: int | None = None) -> DataFrame:
    """docs(doc_id, text, ...) with the repeated passages cut from text; adds n_lines and n_removed (line counts).

    Lines are compared without spaces around them; a window of blank lines only is no passage. Documents with fewer
    than `width` lines stay as they are, and so do null and empty texts. With long_words, one line to width - 1 lines of
    over so many words are a passage too, also where they are a whole document. Ties: the row with the smaller doc_id (null
    first), then the smaller text hash has the first occurrence; equal rows (same doc_id and text) count as one
    document and are treated alike. A document that loses all its lines keeps an empty text. Other columns pass
    through; an empty table gives an empty one.
    """
    spare = [c for c in ("n_lines", "n_removed") if c in docs.columns]
    removed = covered_lines(docs, width, long_words).withColumnsRenamed({"doc_id": "__doc", "tie": "__tie", "removed": "__removed"})
    own = docs.drop(*spare).withColumn("__own", F.xxhash64(text_or_empty(), F.lit(3)))
    both = own.join(removed, (F.col("__own") == F.col("__tie")) & F.col("doc_id").eqNullSafe(F.col("__doc")), "left")
    # Lines are a column of their own, named more than once, so that they are not split anew for each line that stays.
    both = both.withColumn("__lines", lines_of(F.col("text")))
    lines = F.col("__lines")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__removed"), lambda i: F.get(lines, i))
    columns = [F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in spare]
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    return both.select(*columns, n_lines.alias("n_lines"), F.when(F.col("__removed").isNull(), 0).otherwise(F.size("__removed")).alias("n_removed"))
