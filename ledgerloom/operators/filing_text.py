"""Finding documents, cleaning sections, the exhibit fallback, and the text dataset."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import columns as P
from ledgerloom.operators.filing_html import extract_sections, parse_documents
from ledgerloom.sources.readers import primary_documents

# Running lines that are removed, before non-breaking spaces become spaces; white space is Unicode's.
PAGE_HEADER = r"(?diU)(?:^|\n)\s*\d{1,3}\s+Table of Contents\s*(?:\n|$)"
CONTENTS_LINE = r"(?dimU)^\s*Table of Contents\s*$"
PAGE_FOOTER = r"(?dimU)^\s*(?:\d{4}\s+)?(?:Form\s+10-K|Annual\s+Report(?:\s+on\s+Form\s+10-K)?)\s+\d{1,3}\s*$"
PAGE_NUMBER = r"(?dmU)^\s*\d{1,3}\s*$"
NUMBER_TOKEN = r"^[0-9$%,.()\-–−]+$"
STUB_WORDS, EXHIBIT_TRIES = 500, 3


def _tokens(line: Column) -> Column:
    return F.filter(F.split(line, r"(?U)\s+", -1), lambda t: t != "")


def _is_number_line(line: Column) -> Column:
    tokens = _tokens(line)
    n, k = F.size(tokens), F.size(F.filter(tokens, lambda t: t.rlike(NUMBER_TOKEN)))
    # The cheap tests come first: most lines have fewer than three digits in them.
    return F.when(~line.rlike(r"\d\D+\d|\d{3}"), F.lit(False)).otherwise((n >= 4) & (k >= 3) & (k / n > 0.4))


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def clean_sections(df: DataFrame, text: str, least_lines: int = 50, most_words: int = 8, times: int = 4) -> DataFrame:
    """E9, in place: page headers, contents lines, page footers, page numbers, non-breaking spaces, lines of numbers (at least four tokens, three and over 40 % of them numbers), repeated lines (in texts of more than 50 lines, lines of one to eight words that stand four times or more), blank lines.

    Steps that are used more than once are columns of their own, so that they are computed once.
    """
    c = F.regexp_replace(F.col(text), PAGE_HEADER, "\n")
    for pattern in (CONTENTS_LINE, PAGE_FOOTER, PAGE_NUMBER):
        c = F.regexp_replace(c, pattern, "")
    c = F.replace(c, F.lit(" "), F.lit(" "))
    out = df.withColumn("__lines", F.filter(F.split(c, "\n", -1), lambda x: ~_is_number_line(x)))
    out = out.withColumn("__short", F.when(F.size("__lines") > least_lines, F.array_sort(F.filter(F.transform("__lines", _bare), lambda x: F.size(_tokens(x)).between(1, most_words)))))
    # In the sorted list a line stands `times` times if its equal stands times - 1 places on.
    out = out.withColumn("__often", F.array_distinct(F.filter("__short", lambda x, i: F.get("__short", i + times - 1) == x)))
    kept = F.when(F.size("__often") > 0, F.filter("__lines", lambda x: ~F.array_contains("__often", _bare(x)))).otherwise(F.col("__lines"))
    joined = F.regexp_replace(F.array_join(kept, "\n"), r"(?U)\n\s*\n", "\n")
    return out.withColumn(text, _bare(joined)).drop("__lines", "__short", "__often")


def is_reference_stub(stub: str | Column) -> Column:
    """A short section that points elsewhere."""
    c = F.lower(P.col(stub))
    return (P.word_count(stub) < STUB_WORDS) & (c.contains("incorporat") | c.contains("refer to") | c.contains("annual report"))


def exhibit_fallback(stubs: DataFrame, exhibits: DataFrame, target: str, key: str = "accession_number") -> DataFrame:
    """Key and section from the first exhibit that has it.

    stubs: key, stub. exhibits: key, exhibit_type, html. An exhibit number in the
    stub is the only one tried; else those of types EX-13 and EX-99(.n), at most
    three, in order of type. Only exhibits of stubs are parsed.
    """
    refs = stubs.filter(F.coalesce(is_reference_stub("stub"), F.lit(False)))
    refs = refs.withColumn("named", F.nullif(F.regexp_extract("stub", r"(?i)exhibit\s+\(?(\d+(?:\.\d+)?)\)?", 1), F.lit("")))
    joined = refs.join(exhibits, key).withColumn("number", F.regexp_extract("exhibit_type", r"^EX-(.*)$", 1))
    wanted = F.when(F.col("named").isNotNull(), F.col("number") == F.col("named")).otherwise(F.col("exhibit_type").rlike(r"^EX-(13|99(\.\d+)?)$"))
    w = Window.partitionBy(key).orderBy("exhibit_type")
    tries = joined.filter(wanted).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= EXHIBIT_TRIES)
    parsed = parse_documents(tries, "html", (key, "rank"))
    found = extract_sections(parsed, (target,), (key, "rank"), stubs=False).filter(F.col(f"item_{target}").isNotNull())
    return found.groupBy(key).agg(F.min_by(f"item_{target}", "rank").alias("section"))


def extract_filings(filings: DataFrame, exhibits: DataFrame | None = None, key: str = "accession_number", targets: Sequence[str] = ("1a", "7")) -> DataFrame:
    """Key, item_1a, item_7, cleaned; NULL where nothing was found. filings: key, html."""
    found = extract_sections(parse_documents(filings, "html", (key,)), tuple(targets), (key,))
    for t in targets:
        if exhibits is not None:
            stubs = found.filter(f"item_{t} is null and stub_{t} is not null").select(key, F.col(f"stub_{t}").alias("stub"))
            other = exhibit_fallback(stubs, exhibits, t, key).withColumnRenamed("section", "__other")
            found = found.join(other, key, "left").withColumn(f"item_{t}", F.coalesce(f"item_{t}", "__other")).drop("__other")
        found = clean_sections(found, f"item_{t}")
    return found.select(key, *(f"item_{t}" for t in targets))


def filing_documents(filings: DataFrame, ciks: DataFrame, subs: DataFrame, html: DataFrame) -> DataFrame:
    """The filings with cik, doc, html and status, which names the first lookup that missed.

    filings: ticker, accession_number and more, one row each, as they stay. ciks: ticker, cik,
    as readers.first_cik() gives them. The document of an accession is that of the recent
    batch; one that is missing or empty there comes from the older batches. html: doc, html
    and, where known, accession_number, as file names repeat between filers; a file without
    one serves any filing of its name. status is found, no cik, no document or no file.
    """
    every = reduce(DataFrame.union, (primary_documents(subs, older).filter("doc <> ''").withColumn("older", F.lit(older)) for older in (False, True)))
    docs = every.groupBy("cik", "accession_number").agg(F.min_by("doc", "older").alias("doc"))
    at = filings.join(ciks.select("ticker", "cik"), "ticker", "left").join(docs, ["cik", "accession_number"], "left")
    accession = F.col("accession_number") if "accession_number" in html.columns else F.lit(None).cast("string")
    files = html.select("doc", accession.alias("accession_number"), "html")
    own = files.filter("accession_number is not null").dropDuplicates(["accession_number", "doc"]).withColumnRenamed("html", "__own")
    named = files.filter("accession_number is null").dropDuplicates(["doc"]).select("doc", F.col("html").alias("__named"))
    out = at.join(own, ["accession_number", "doc"], "left").join(named, "doc", "left").withColumn("html", F.coalesce("__own", "__named"))
    status = F.when(F.col("cik").isNull(), "no cik").when(F.col("doc").isNull(), "no document").when(F.col("html").isNull(), "no file").otherwise("found")
    return out.select(*filings.columns, "cik", "doc", "html", status.alias("status"))


def text_dataset(panel: DataFrame, filings: DataFrame, exhibits: DataFrame | None = None, done: DataFrame | None = None, ciks: DataFrame | None = None) -> DataFrame:
    """Ticker, fiscal_year, item_1a, item_7 and status for each original filing that is not done.

    status is extracted, failed (no document, or nothing found; written with
    NULLs and so not tried again) or, without a cik, skipped and not written.
    """
    from ledgerloom.operators.filters import original_filings, resume

    todo = original_filings(panel)
    if done is not None:
        todo = resume(todo, done)
    if ciks is not None:
        todo = todo.join(ciks.select("ticker").distinct(), "ticker", "left_semi")
    wanted = todo.join(filings.select("accession_number", "html"), "accession_number", "left")
    texts = extract_filings(wanted.filter("html is not null").select("accession_number", "html").dropDuplicates(["accession_number"]), exhibits)
    out = todo.join(texts, "accession_number", "left")
    status = F.when(F.col("item_1a").isNotNull() | F.col("item_7").isNotNull(), "extracted").otherwise("failed")
    return out.select("ticker", "fiscal_year", P.one_line("item_1a").alias("item_1a"), P.one_line("item_7").alias("item_7"), status.alias("status"))


def progress(dataset: DataFrame) -> DataFrame:
    """A20"""
    return dataset.groupBy("status").agg(F.count("*").alias("n"))
