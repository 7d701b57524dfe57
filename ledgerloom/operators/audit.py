"""V2 to V8: attaching texts, reading verdicts, and their summary."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import CRITERIA, SCORES
from ledgerloom.functions import columns as P
from ledgerloom.functions.statistics import wilson


def attach_text(sample: DataFrame, texts: DataFrame, keys: Sequence[str] = ("ticker", "fiscal_year"), section: str = "section") -> DataFrame:
    """V2: text, word_count and extract_error of each sampled section; texts holds one column for each section."""
    names = [c for c in texts.columns if c not in keys]
    joined = sample.join(texts.withColumn("__found", F.lit(True)), list(keys), "left")
    text = F.coalesce(*(F.when(F.col(section) == s, F.col(s)) for s in names))
    out = joined.withColumn("text", F.coalesce(text, F.lit(""))).withColumn("word_count", P.word_count("text"))
    error = F.when(F.col("__found").isNull(), "no filing").when(F.col("text") == "", "empty").otherwise("")
    return out.withColumn("extract_error", error).drop("__found", *names)


def prompts(sample: DataFrame, template: str, section: str = "section", text: str = "text") -> DataFrame:
    """V3: the template's %s are section and text."""
    return sample.withColumn("prompt", F.format_string(template, section, text))


def parse_response(raw: str | Column) -> Column:
    """V4: map of lower-case keys to values of "Key: value" lines; a value that begins with a score becomes that score, notes too; the last line of a key wins."""
    lines = F.filter(F.split(P.col(raw), "\n", -1), lambda x: F.instr(x, ":") > 0)

    def entry(line: Column) -> Column:
        at = F.instr(line, ":")
        key = F.replace(F.lower(F.trim(F.substring(line, F.lit(1), at - 1))), F.lit(" "), F.lit("_"))
        value = F.trim(F.substring(line, at + 1, F.length(line)))
        scored = reduce(lambda c, s: c.when(F.lower(value).startswith(s.lower()), F.lit(s)), SCORES[1:], F.when(F.lower(value).startswith(SCORES[0].lower()), F.lit(SCORES[0])))
        return F.struct(key.alias("key"), scored.otherwise(value).alias("value"))

    entries = F.transform(lines, entry)
    # The last of equal keys: an entry stays if no later one has its key.
    last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def call_status(sample: DataFrame, calls: DataFrame, keys: Sequence[str], most_tries: int = 5, wait: float = 20.0) -> DataFrame:
    """V6: the sample with response, tries, waited and status of its calls to an outside model.

    calls: keys, try (from 1), response (NULL if the call failed). The first
    response within ``most_tries`` counts; each failed try before it waits
    ``wait`` times its number in seconds. status is recorded, retry (none
    answered, or none was made: so a next run calls again) and, while tries are left, open.
    """
    got = F.col("response").isNotNull()
    tried = calls.filter(F.col("try").between(1, most_tries)).groupBy(*keys).agg(
        F.min_by(F.when(got, F.col("response")), F.when(got, F.col("try"))).alias("response"), F.min(F.when(got, F.col("try"))).alias("__good"), F.max("try").alias("__last")
    )
    tries = F.coalesce("__good", "__last", F.lit(0))
    failed = F.when(F.col("__good").isNotNull(), F.col("__good") - 1).otherwise(tries)
    status = F.when(F.col("__good").isNotNull(), "recorded").when(tries.between(1, most_tries - 1), "open").otherwise("retry")
    out = sample.join(tried, list(keys), "left")
    return out.select(*sample.columns, "response", tries.cast("int").alias("tries"), (F.lit(wait) * failed * (failed + 1) / 2).alias("waited"), status.alias("status"))


def verdicts(sample: DataFrame, raw: str = "response", criteria: Sequence[str] = CRITERIA) -> DataFrame:
    """V5: a column for each criterion and notes; empty text fails everything, a missing or unknown score is PARSE_ERR."""
    out = sample.withColumn("__m", parse_response(raw))
    empty = F.coalesce(F.trim("text") == "", F.lit(True))
    for c in criteria:
        got = F.col("__m")[c]
        out = out.withColumn(c, F.when(empty, "Fail").when(got.isin(*SCORES), got).otherwise("PARSE_ERR"))
    notes = F.when(empty, F.coalesce(F.nullif(F.col("extract_error"), F.lit("")), F.lit("empty text"))).otherwise(F.coalesce(F.col("__m")["notes"], F.lit("")))
    return out.withColumn("notes", notes).drop("__m").withColumn("quality", P.quality_tag(list(criteria)))


def criterion_rates(df: DataFrame, criteria: Sequence[str] = CRITERIA) -> DataFrame:
    """For each criterion the counts, strict and lenient rates and the Wilson interval of the lenient one; parse errors count in n only."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("criterion"), F.col(c).alias("score")) for c in criteria))).alias("x")).select("x.*")
    ok = lambda *s: F.count_if(F.col("score").isin(*s))
    out = long.groupBy("criterion").agg(
        F.count("*").alias("n"), ok("Pass").alias("n_pass"), ok("Minor").alias("n_minor"), ok("Fail").alias("n_fail"),
        F.count_if(F.coalesce(~F.col("score").isin(*SCORES), F.lit(True))).alias("n_error"),
    )
    lenient = F.col("n_pass") + F.col("n_minor")
    low, high = wilson(lenient, F.col("n"))
    return out.withColumns({"strict": F.col("n_pass") / F.col("n"), "lenient": lenient / F.col("n"), "low": low, "high": high})


def overall_rates(df: DataFrame, by: Sequence[str] = (), criteria: Sequence[str] = CRITERIA) -> DataFrame:
    """Rows in which all criteria pass, strictly or with minor flaws, by group."""
    every = lambda *s: reduce(lambda a, b: a & b, [F.coalesce(F.col(c).isin(*s), F.lit(False)) for c in criteria])
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(every("Pass")).alias("n_strict"), F.count_if(every("Pass", "Minor")).alias("n_lenient"))
    low, high = wilson(F.col("n_lenient"), F.col("n"))
    return out.withColumns({"strict": F.when(F.col("n") > 0, F.col("n_strict") / F.col("n")), "lenient": F.when(F.col("n") > 0, F.col("n_lenient") / F.col("n")), "low": low, "high": high})


def failures(df: DataFrame, criteria: Sequence[str] = CRITERIA) -> DataFrame:
    """V8: rows with any Fail, and which criteria failed."""
    failed = F.array_compact(F.array(*(F.when(F.col(c) == "Fail", F.lit(c)) for c in criteria)))
    return df.withColumn("failed", F.concat_ws(",", failed)).filter("failed <> ''")


def summary(df: DataFrame) -> dict[str, DataFrame]:
    """V8: the report's tables."""
    from ledgerloom.functions.columns import era

    tagged = df.withColumn("era", era("fiscal_year"))
    return {"criteria": criterion_rates(df), "overall": overall_rates(df), "by_era": overall_rates(tagged, ["era"]), "by_section": overall_rates(df, ["section"]), "failures": failures(df)}


def batch_audit(log: DataFrame) -> DataFrame:
    """S12 summarised: counts of each status and flag of both items."""
    parts = [log.select(F.lit(i).alias("item"), F.col(f"{i}_status").alias("status"), F.col(f"{i}_flags").alias("flags")) for i in ("item_1a", "item_7")]
    long = parts[0].union(parts[1])
    status = long.groupBy("item", F.col("status").alias("value")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("status"))
    flags = long.select("item", F.explode(F.split("flags", r"[,;|\s]+", -1)).alias("value")).filter("value <> ''").groupBy("item", "value").agg(F.count("*").alias("n")).withColumn("kind", F.lit("flag"))
    return status.unionByName(flags).select("item", "kind", "value", "n")
