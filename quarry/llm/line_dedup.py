"""Line dedup with a suffix array over line ids, built by distributed prefix doubling; DataFrame operations only.

A text is the sequence of its lines that hold a word (blank lines belong to the line before them). Round 0 names each
line by its content; round k+1 names the 2^(k+1) lines that start at a place by the pair of ranks of its two halves. Ranks
come from a range sort of the distinct names that occur more than once, so they are the order of the suffix array, and the
suffixes of one rank are an interval whose longest common prefix has at least 2^k lines. Runs of a length between two
powers are the meet of two intervals: that of their first and that of their last 2^k lines.

A line goes if it lies in a run that occurred before and has at least `min_words` words. Every such run, however long, is
the union of shortest ones: those that reach so many words from some first line on, or up to some last line. A suffix
therefore leaves the doubling when it is in no interval, or when its common prefix goes beyond every shortest run; rounds
end by themselves, when no suffix is left. Besides, a single line of at least `common_words` words that stands at
`common_places` places or more goes wherever it occurred before. Before means in an earlier document (by id, null first,
then md5 of text) or earlier in the same one.

Copies of one whole text are one sequence: the first document's. The others lie in a run that occurred before as a whole.
Copies of a name meet as one row per name (partial aggregation); names of more than a thousandth of all places, at most a
thousand, are joined by broadcast, so no task gets all places of a hot line.

Defined results: null text stays null with no lines; a text without a word has none either and stays as it is; rows equal in
id and text are one document and get the same result; null ids come first; an empty table gives an empty result; other
columns are kept, whatever their names, but clean() replaces n_lines and n_removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, kept, n_words, saved

MIN_WORDS = 10
COMMON_WORDS, COMMON_PLACES = 5, 50
#: dedup() drops documents of which less than this share of the words is left.
REMNANT = 0.25
#: A name with more than one in so many of all places is hot, from so many places on.
HOT, HOT_PLACES = 1000, 2000
_PLACE = ["_doc", "_sum", "_pos"]


def _lines(text: Column) -> Column:
    """Lines with the blank lines that follow them; blank lines at the start are one more, without a word."""
    return F.split(text, r"\n(?=[\x20\x09\x0B-\x0D]*+[^\x20\x09-\x0D])", -1)


def _count(line: Column, most: int) -> Column:
    """Words of the line, as far as so many: more decide nothing."""
    return n_words(F.regexp_extract(line, rf"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){{0,{most}}}+", 0))


def _interval(rows: DataFrame, name: list[str], rank: str | None = "_rank") -> DataFrame | None:
    """The rows whose name occurs more than once (None: there is none), with the rank of the name in suffix-array order,
    _later (not the first of them) and _weight (all places of the name). Only names with their first place move to be ranked."""
    groups = rows.groupBy(*name).agg(F.count("*").alias("_n"), F.sum("_copies").alias("_weight"), F.min(F.struct(*_PLACE)).alias("_first")).where("_n > 1 or _weight > 1")
    if rank:
        groups = groups.repartitionByRange(*name).sortWithinPartitions(*name).withColumn("_new", F.monotonically_increasing_id())
    groups = saved(groups)
    most = groups.agg(F.max("_n")).first()[0]
    if most is None:
        return None
    found = rows.join(groups, name)
    if most >= HOT_PLACES and most * HOT > (total := rows.count()):
        hot = groups.where(F.col("_n") * HOT > total)  # fewer than HOT rows
        found = rows.join(F.broadcast(hot), name).unionByName(rows.join(F.broadcast(hot.select(*name)), name, "left_anti").join(groups, name))
    own = [c for c in rows.columns if c != "_rank"]
    more = [F.col("_new").alias(rank)] if rank else []
    return found.select(*own, *more, (F.struct(*_PLACE) > F.col("_first")).alias("_later"), "_weight")


def _shortest(words: Column, i: Column, least: int) -> list[tuple[Column, Column]]:
    """(start, lines) of the shortest runs that reach so many words: from line i on, and up to line i; lines is 0 without one."""

    def reach(part: Column) -> Column:
        step = lambda s, w: F.when(s["n"] >= least, s).otherwise(F.struct((s["n"] + w).alias("n"), (s["k"] + 1).alias("k")))
        end = F.aggregate(part, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("k")), step)
        return F.when(end["n"] >= least, end["k"]).otherwise(F.lit(0))

    onward = reach(F.slice(words, i + 1, F.lit(least)))
    back = reach(F.reverse(F.slice(words, F.greatest(i + 2 - least, F.lit(1)), F.least(i + 1, F.lit(least)))))
    return [(i, onward), (i + 1 - back, back)]


def _copies(docs: DataFrame, least: int) -> tuple[DataFrame, bool]:
    """_doc, _sum, _copies of texts of enough words that several documents have: the first one's row has their number,
    the others have 0. And whether any rows are equal in id and text."""
    rows = docs.where("text is not null").select(F.col("doc_id").alias("_doc"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("_sum"), (_count(F.col("text"), least) >= least).alias("_whole"))
    rows = kept(rows.groupBy("_doc", "_sum", "_whole").agg(F.count("*").alias("_rows")).withColumn("_pos", F.lit(0)).withColumn("_copies", F.lit(1).cast("long")))
    again = _interval(rows.where("_whole"), ["_sum"], None)
    twins = (rows.agg(F.max("_rows")).first()[0] or 0) > 1
    if again is None:
        return rows.where("false").select("_doc", "_sum", "_copies"), twins
    return kept(again.select("_doc", "_sum", F.when(F.col("_later"), F.lit(0)).otherwise(F.col("_weight")).cast("long").alias("_copies"))), twins


def repeated(docs: DataFrame, min_words: int = MIN_WORDS, common_words: int = COMMON_WORDS, common_places: int = COMMON_PLACES) -> tuple[DataFrame, DataFrame]:
    """_doc, _sum, _from, _lines: runs that occurred before; _doc, _sum: documents that did as a whole.

    The id and the md5 of the text name a document, _from counts the places of its array of lines.
    """
    copies, twins = _copies(docs, min_words)
    texts = docs.where("text is not null").select(F.col("doc_id").alias("_doc"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("_sum"), _lines(F.col("text")).alias("_units"))
    names = F.transform("_units", lambda x: F.unhex(F.md5(F.substring_index(x, "\n", 1).cast("binary"))))
    texts = texts.select("_doc", "_sum", names.alias("_names"), F.transform("_units", lambda x: _count(x, max(min_words, common_words))).alias("_counts"))
    marks = copies.select(F.col("_doc").alias("_d"), F.col("_sum").alias("_s"), "_copies")
    texts = texts.join(marks, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_sum") == F.col("_s")), "left").withColumn("_copies", F.coalesce("_copies", F.lit(1).cast("long"))).where("_copies > 0")
    lines = texts.select("_doc", "_sum", "_copies", "_counts", F.posexplode("_names").alias("_pos", "_name"))
    runs = [F.struct(start.alias("start"), size.alias("size")) for start, size in _shortest(F.col("_counts"), F.col("_pos"), min_words)]
    lines = lines.select("_doc", "_sum", "_copies", "_pos", "_name", F.get("_counts", F.col("_pos")).alias("_words"), F.array_distinct(F.filter(F.array(*runs), lambda r: r["size"] > 0)).alias("_runs")).where("_words > 0")
    lines = kept(lines.dropDuplicates(_PLACE) if twins else lines)
    whole = copies.where("_copies = 0").select("_doc", "_sum")
    active = _interval(lines, ["_name"])
    if active is None:
        return lines.where("false").select("_doc", "_sum", F.col("_pos").alias("_from"), F.lit(1).alias("_lines")), whole
    active = kept(active)
    found = [active.where(F.col("_later") & (F.col("_words") >= common_words) & (F.col("_weight") >= common_places)).select("_doc", "_sum", F.col("_pos").alias("_from"), F.lit(1).alias("_lines"))]
    wanted = active.select("_doc", "_sum", "_copies", F.explode("_runs").alias("_run")).select("_doc", "_sum", "_copies", F.col("_run.start").alias("_pos"), F.col("_run.size").alias("_lines"))
    wanted = kept(wanted.distinct())
    active = active.select("_doc", "_sum", "_pos", "_copies", "_rank", "_words", F.col("_words").alias("_head"), F.col("_words").alias("_last"))
    length, longest = 1, wanted.agg(F.max("_lines")).first()[0] or 0
    while length <= longest:
        # runs of length to 2 * length - 1 lines, by the ranks of their first and of their last lines
        own = wanted.where((F.col("_lines") >= length) & (F.col("_lines") < 2 * length)).withColumn("_at", F.col("_pos") + F.col("_lines") - length)
        here = active.select(F.col("_doc").alias("_d"), F.col("_sum").alias("_s"), F.col("_pos").alias("_p"), F.col("_rank").alias("_r"))
        for at, name in (("_pos", "_one"), ("_at", "_two"))[: 1 if length == 1 else 2]:
            own = own.join(here, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_sum") == F.col("_s")) & (F.col(at) == F.col("_p"))).withColumnRenamed("_r", name).drop("_d", "_s", "_p")
        later = _interval(kept(own), ["_lines", "_one", "_two"] if length > 1 else ["_lines", "_one"], None)
        if later is not None:
            found.append(later.where("_later").select("_doc", "_sum", F.col("_pos").alias("_from"), "_lines"))
        if 2 * length > longest:
            break
        below = Window.partitionBy("_doc", "_sum").orderBy("_pos").rangeBetween(length, length)
        step = lambda c: F.max(c).over(below)
        pairs = active.select("_doc", "_sum", "_pos", "_copies", "_rank", step("_rank").alias("_next"), (F.col("_words") + step("_words")).alias("_words"), "_head", step("_last").alias("_last"))
        # within a shortest run: without its first or without its last line it has too few words
        pairs = pairs.where(F.col("_next").isNotNull() & (F.col("_words") - F.greatest("_head", "_last") < min_words))
        active = _interval(kept(pairs), ["_rank", "_next"])
        if active is None:
            break
        active = kept(active.drop("_next", "_later", "_weight"))
        length *= 2
    runs_ = found[0]
    for more in found[1:]:
        runs_ = runs_.unionByName(more)
    return runs_, whole


def _cleaned(docs: DataFrame, *limits: int) -> DataFrame:
    """row (the document as a struct, with its new text), n_lines, n_removed, had (words of the text as it was)."""
    runs, whole = repeated(docs, *limits)
    gone = runs.withColumn("_at", F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("_lines") - 1)))
    gone = gone.groupBy("_doc", "_sum").agg(F.collect_set(F.col("_at").cast("int")).alias("_gone")).withColumn("_all", F.lit(False))
    gone = gone.unionByName(whole.select("_doc", "_sum", F.array().cast("array<int>").alias("_gone"), F.lit(True).alias("_all")))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("sum"))
    rows = rows.join(gone, F.col("id").eqNullSafe(F.col("_doc")) & (F.col("sum") == F.col("_sum")), "left")
    units, text = _lines(F.col("row.text")), F.col("row.text")
    holds = lambda x: x.rlike(WORD)
    lost = F.col("_gone").isNotNull()
    kept_ = F.filter(units, lambda x, i: ~((F.col("_all") & holds(x)) | F.array_contains("_gone", i)))
    lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.filter(units, holds))).cast("long")
    removed = F.when(~lost, F.lit(0)).when(F.col("_all"), lines).otherwise(F.size("_gone")).cast("long")
    new = F.when(lost, F.array_join(kept_, "\n")).otherwise(text)
    return rows.select(F.col("row").withField("text", new).alias("row"), lines.alias("n_lines"), removed.alias("n_removed"), n_words(text).alias("had"))


def clean(docs: DataFrame, min_words: int = MIN_WORDS, common_words: int = COMMON_WORDS, common_places: int = COMMON_PLACES) -> DataFrame:
    """The documents with text without the deleted lines, n_lines (lines with a word) and n_removed (those deleted)."""
    rows = _cleaned(docs, min_words, common_words, common_places)
    own = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return rows.select(*own, "n_lines", "n_removed")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, common_words: int = COMMON_WORDS, common_places: int = COMMON_PLACES, remnant: float = REMNANT) -> DataFrame:
    """The documents with their columns. Those go of which the deletion left no word, or less than `remnant` of the words:
    what is left of a near copy of an earlier document are its few changed lines, and nothing later would know them as one."""
    rows = _cleaned(docs, min_words, common_words, common_places)
    left = n_words(F.col("row.text"))
    rows = rows.where((F.col("n_removed") == 0) | ((left > 0) & (left >= F.lit(remnant) * F.col("had"))))
    if "n_chars" in docs.columns:
        rows = rows.select(F.col("row").withField("n_chars", F.length("row.text").cast(docs.schema["n_chars"].dataType)).alias("row"))
    return rows.select("row.*")
