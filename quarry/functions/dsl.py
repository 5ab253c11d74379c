"""The explanation language as Column functions: sections, primitives, ids, edges, judge replies, keys. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the language. (?U) makes \w, \d, \s and \b Unicode-aware.
PRIMITIVE = r"(?Um)^[ \t]*([A-Za-z_][A-Za-z0-9_]*)\s*\("
EDGE = r"""(?U)edge\("(n\d+)",\s*"(n\d+)",\s*relation="(\w+)"\)"""
ID_DEF = r"""(?U)\bid\s*=\s*['"](n\d+)['"]"""
ID_USE = r"(?U)\b(n\d+)\b"
SECTIONS = ("think", "answer", "explain", "dag")


def primitives(text: Column) -> Column:
    """names called at line starts, in order; null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(PRIMITIVE), F.lit(1)), F.array().cast("array<string>"))


def edges(dag: Column) -> Column:
    """array of (src, tgt, relation); of repeated (src, tgt) the last relation stays, at the first place.

    Make it a column of its own before it is used more than once.
    """
    group = lambda k: F.coalesce(F.regexp_extract_all(dag, F.lit(EDGE), F.lit(k)), F.array().cast("array<string>"))
    parsed = F.transform(F.arrays_zip(group(1).alias("src"), group(2).alias("tgt"), group(3).alias("relation")), lambda e: F.struct(e["src"].alias("src"), e["tgt"].alias("tgt"), e["relation"].alias("relation")))

    def once(found: Column) -> Column:
        # from the last to the first: an edge stays if its ends aren't there yet; its place is that of its first mention
        ends = F.transform(found, lambda e: F.struct(e["src"], e["tgt"]))
        last = F.transform(F.array_distinct(ends), lambda k: F.element_at(F.filter(found, lambda e: F.struct(e["src"], e["tgt"]) == k), -1))
        return F.when(F.size(F.array_distinct(ends)) == F.size(found), found).otherwise(last)

    # the parsed edges are bound to a variable, so they are extracted once
    return F.get(F.transform(F.array(parsed), once), F.lit(0))


def defined_ids(text: Column) -> Column:
    """ids given with id="n..."."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(ID_DEF), F.lit(1)), F.array().cast("array<string>"))


def used_ids(dag: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(dag, F.lit(ID_USE), F.lit(1)), F.array().cast("array<string>"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def section(text: Column, tag: str) -> Column:
    """first <tag>...</tag>, any case, stripped; '' if there is none or text is null."""
    return F.coalesce(strip(F.regexp_extract(text, f"(?is)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))


def strict_section(text: Column, tag: str) -> Column:
    """as section(), but in lower case only and null if there is none."""
    pattern = f"(?s)<{tag}>(.*?)</{tag}>"
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))


def judge_answer(text: Column) -> Column:
    """what stands between the first <answer> and the next </answer>; null without it."""
    return F.when(text.contains("<answer>"), F.substring_index(F.element_at(F.split(text, "<answer>", 2), 2), "</answer>", 1))


def json_object(text: Column) -> Column:
    """from the first brace to the last one; null without them."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def judge_scores(text: Column, keys: list[str]) -> Column:
    """A struct of scores out of ten as shares; missing or unreadable ones are 0."""
    body = json_object(text)
    score = lambda k: F.get_json_object(body, f"$.{k}").try_cast("double")
    return F.struct(*(F.coalesce(score(k) / 10, F.lit(0.0)).alias(k) for k in keys))


def natural_key(text: Column) -> Column:
    """Sorts digit runs as numbers of any size and the rest in lower case: digits stand behind their number of digits."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    return F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(digits(x)).cast("string"), 10, "0"), digits(x))).otherwise(x))


def known_targets(text: Column) -> Column:
    """F12 for strings: parts between commas, untrimmed; null gives none."""
    return F.coalesce(F.split(text, ","), F.array().cast("array<string>"))


def index_tag(path: Column) -> Column:
    """the prefix that a data set's path gives to indexes. The names of the data sets."""
    number = F.regexp_extract(path, r"(\d+)", 1)
    return F.when(path.contains("tahoe"), F.lit("tahoe_")).when(path.contains("rxrx"), F.concat(F.lit("rxrx_"), number, F.lit("_"))).otherwise(F.lit(""))


def quote(text: Column, plus: bool = False) -> Column:
    """percent encoding as urllib's quote, which keeps / and ~, or with plus as its quote_plus, which keeps ~ alone."""
    coded = F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return coded if plus else F.replace(F.replace(coded, F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def prompt_key(prompt: Column) -> Column:
    """F17."""
    return F.md5(prompt.cast("binary"))


def first_with_prefix(values: Column, prefix: str) -> Column:
    """P07."""
    return F.get(F.filter(values, lambda s: F.startswith(s, F.lit(prefix))), F.lit(0))


def first_without_digit(values: Column) -> Column:
    """P06."""
    return F.get(F.filter(values, lambda s: ~s.rlike(r"(?U)\d")), F.lit(0))
