"""Numbering sheets: rules in the style sheet's language, taken apart into relations, and the labels that they give.

A sheet has a rule for each paragraph class `<list>-num-<number>-<level>`. The rule's generated content is text and
counters, which may be those of other levels; a counter of another level is written in that level's own style. Counters
start where the sheet resets them, and go back there after each item of a smaller level of their list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The shape of a rule, of a declaration, of a part of generated content, of a counter's reset, of a class.
RULE = r"([^{}]+)\{([^}]*)\}"
DECLARATION = r"""([\w-]+)\s*:\s*((?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^;"'])*)"""
PART = r'"((?:[^"\\]|\\.)*)"|counter\(\s*([^,)\s]+)\s*(?:,\s*([^)\s]+))?\s*\)'
RESET = r"(\S+)(?:\s+([+-]?[0-9]+(?:\.[0-9]+)?)(?=\s|\z))?"
CLASS, LEVEL = r"\Ap\.([\w-]+-num-\d+-\d+)(:before)?\z", r"\A(.*-num-\d+)-(\d+)\z"
BULLET = "•"


def _found(text, pattern: str, *groups: int):
    """Arrays of the groups of each match, side by side."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups])


def _unescaped(text):
    """Character escapes, a backslash and up to six hexadecimal digits with a blank behind, as characters."""
    pieces = _found(text, r"([^\\]+)|\\([0-9a-fA-F]{1,6})\s?|(\\)", 1, 2, 3)
    char = lambda code: F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
    whole = F.aggregate(pieces, F.lit(""), lambda s, p: F.concat(s, p["g1"], F.when(p["g2"] != "", char(p["g2"])).otherwise(""), p["g3"]))
    return F.when(text.contains("\\"), whole).otherwise(text)


def parse_sheets(sheets: DataFrame, key: str = "doc_id", css: str = "css") -> tuple[DataFrame, DataFrame, DataFrame]:
    """sheets (key, css) -> rules (key, class, list_style, font), parts (key, class, part, text, counter, style) of each
    class's generated content in order, and starts (key, counter, start).

    Later declarations win. A class whose content has a background, i.e. a picture as bullet, is a round bullet. Escapes
    in content are characters. Other selectors count for resets only. Null sheets have no rules."""
    rules = sheets.select(key, F.posexplode(_found(F.col(css), RULE, 1, 2)).alias("_rule", "_m")).select(key, "_rule", T.trimmed(F.col("_m.g1")).alias("_selector"), F.col("_m.g2").alias("_body"))
    each = rules.select(key, "_rule", "_selector", F.posexplode(_found(F.col("_body"), DECLARATION, 1, 2)).alias("_at", "_d"))
    declared = each.select(key, "_rule", "_selector", F.lower("_d.g1").alias("_name"), "_at", T.trimmed(F.col("_d.g2")).alias("_value"))
    declared = declared.groupBy(key, "_rule", "_selector", "_name").agg(F.max_by("_value", "_at").alias("_value"))

    resets = declared.where(F.col("_name").isin("counter-reset", "counter-set"))
    # of one rule, sets come after resets
    order = F.struct("_rule", (F.col("_name") == "counter-set").alias("set"), F.col("_k"))
    named = resets.select(key, "_rule", "_name", F.posexplode(_found(F.col("_value"), RESET, 1, 2)).alias("_k", "_r"))
    starts = named.select(key, F.col("_r.g1").alias("counter"), F.coalesce(F.expr("try_cast(_r.g2 as double)"), F.lit(0.0)).cast("long").alias("start"), order.alias("_o"))
    starts = starts.where("counter <> ''").groupBy(key, "counter").agg(F.max_by("start", "_o").alias("start"))

    own = declared.withColumn("class", F.regexp_extract("_selector", CLASS, 1)).where("class <> ''").withColumn("_before", F.regexp_extract("_selector", CLASS, 2) != "")
    # a rule's content is a bullet where it has a background as well
    wide = own.groupBy(key, "class", "_rule", "_before").agg(*[F.max(F.when(F.col("_name") == n, F.col("_value"))).alias(c) for n, c in (("content", "_content"), ("background", "_background"), ("font-family", "_font"), ("list-style-type", "_type"))])
    last = lambda c, when: F.max_by(F.when(when, F.col(c)), F.when(when & F.col(c).isNotNull(), F.col("_rule")))
    body = F.when(F.col("_background").isNotNull(), f'"{BULLET}"').otherwise(F.col("_content"))
    made = wide.withColumn("_made", body).groupBy(key, "class").agg(last("_made", F.col("_before")).alias("_made"), last("_font", F.col("_before")).alias("font"), last("_type", ~F.col("_before")).alias("list_style"))
    found = made.select(key, "class", F.posexplode(_found(F.col("_made"), PART, 0, 1, 2, 3)).alias("part", "_p"))
    is_text = F.col("_p.g0").startswith('"')
    parts = found.select(key, "class", "part", F.when(is_text, _unescaped(F.col("_p.g1"))).alias("text"), F.when(~is_text, F.col("_p.g2")).alias("counter"), F.when(~is_text, F.when(F.col("_p.g3") != "", F.col("_p.g3")).otherwise("decimal")).alias("style"))
    rules = made.select(key, "class", "list_style", F.regexp_replace("font", "\\A[\"']|[\"']\\z", "").alias("font"))
    return rules, parts.where("counter IS NOT NULL OR text <> ''"), starts


def labels(items: DataFrame, sheets: DataFrame, key: str = "doc_id", seq: str = "seq", name: str = "class", css: str = "css") -> DataFrame:
    """items (key, seq, class) with label, by the sheet of their key.

    Empty for classes of another shape or without a rule; a class without content has its counter in its list style and a
    blank. The value of a counter at an item is what its own items since its last reset add to its start: one union of
    items, resets and look-ups, and two windows by counter. Null classes have empty labels; seq tells items of a key apart."""
    rules, parts, starts = parse_sheets(sheets, key, css)
    rows = items.select(key, seq, name, F.regexp_extract(name, LEVEL, 1).alias("_base"), F.expr(f"try_cast(regexp_extract({name}, '{LEVEL.replace(chr(92), chr(92) * 2)}', 2) as int)").alias("_level"))
    numbered = rows.where("_base <> ''")
    levels = starts.select(F.col(key).alias("_key"), F.col("counter").alias("_counter"), F.regexp_extract("counter", LEVEL, 1).alias("_b"), F.expr(f"try_cast(regexp_extract(counter, '{LEVEL.replace(chr(92), chr(92) * 2)}', 2) as int)").alias("_l"))
    at = lambda df, counter, add, reset, part: df.select(F.col(key).alias("_key"), counter.alias("_counter"), F.col(seq).alias("_seq"), F.lit(add).alias("_add"), F.lit(reset).alias("_reset"), part.cast("int").alias("_part"))
    none = F.lit(None)
    counted = at(numbered, F.col(name), 1, 0, none)
    deeper = numbered.join(levels, (F.col(key) == F.col("_key")) & (F.col("_base") == F.col("_b")) & (F.col("_l") > F.col("_level")) & (F.col("_l") <= 9))
    went_back = deeper.select(F.col(key).alias("_key"), "_counter", F.col(seq).alias("_seq"), F.lit(0).alias("_add"), F.lit(1).alias("_reset"), none.cast("int").alias("_part"))
    # a class without content shows its own counter
    bare = rules.join(parts.select(key, "class").distinct(), [key, "class"], "left_anti").select(key, "class", F.lit(0).alias("part"), none.cast("string").alias("text"), F.col("class").alias("counter"), F.coalesce("list_style", F.lit("none")).alias("style"), F.lit(True).alias("bare"))
    shown = parts.withColumn("bare", F.lit(False)).unionByName(bare)
    # how a counter is written in its own level: its first part there, else its list style
    first = parts.where(F.col("counter") == F.col("class")).groupBy(key, "class").agg(F.min_by("style", "part").alias("_first"))
    own = rules.join(first, [key, "class"], "left").select(F.col(key).alias("_k"), F.col("class").alias("_c"), F.coalesce("_first", "list_style").alias("_own"))
    shown = shown.join(own, (F.col(key) == F.col("_k")) & (F.col("counter") == F.col("_c")), "left").withColumn("style", F.when(F.col("counter") == F.col("class"), F.col("style")).otherwise(F.coalesce("_own", "style"))).drop("_k", "_c", "_own")
    uses = numbered.select(F.col(key).alias("_k"), F.col(seq).alias("_s"), F.col(name).alias("_c")).join(shown, (F.col("_k") == F.col(key)) & (F.col("_c") == F.col("class")))
    looked = uses.where(F.col("counter").isNotNull()).select(F.col("_k").alias("_key"), F.col("counter").alias("_counter"), F.col("_s").alias("_seq"), F.lit(0).alias("_add"), F.lit(0).alias("_reset"), F.col("part").cast("int").alias("_part"))
    every = counted.unionByName(went_back).unionByName(looked)
    order = [F.col("_seq"), F.col("_reset").desc(), F.col("_part").asc_nulls_first()]
    so_far = Window.partitionBy("_key", "_counter").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("_run", F.sum("_reset").over(so_far))
    since = Window.partitionBy("_key", "_counter", "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    values = every.withColumn("_n", F.sum("_add").over(since)).where("_part IS NOT NULL").select("_key", "_seq", "_part", "_counter", "_n")
    begun = starts.select(F.col(key).alias("_k"), F.col("counter").alias("_c"), "start")
    values = values.join(begun, (F.col("_key") == F.col("_k")) & (F.col("_counter") == F.col("_c")), "left").select("_key", "_seq", "_part", (F.coalesce("start", F.lit(0)) + F.col("_n")).alias("_value"))
    written = uses.join(values, (F.col("_k") == F.col("_key")) & (F.col("_s") == F.col("_seq")) & (F.col("part") == F.col("_part")), "left")
    said = F.when(F.col("text").isNotNull(), F.col("text")).otherwise(T.counter(F.col("_value"), F.col("style")))
    said = F.when(F.col("bare") & (said != ""), F.concat(said, F.lit(" "))).otherwise(said)
    joined = written.groupBy("_k", "_s").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", said.alias("t")))), lambda p: p["t"]), "").alias("label"))
    return items.join(joined, (F.col(key) == F.col("_k")) & (F.col(seq) == F.col("_s")), "left").select(*items.columns, F.coalesce("label", F.lit("")).alias("label"))
