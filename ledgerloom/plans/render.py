"""K6: result tables as LaTeX, from a few collected rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ledgerloom.operators.regression import Fit


def _stars(p: float) -> str:
    return "***" if p < 0.01 else "**" if p < 0.05 else "*" if p < 0.10 else ""


def _num(x: float | None, digits: int = 3) -> str:
    return "" if x is None else f"{x:.{digits}f}".replace("-", "$-$")


def _table(header: Sequence[str], rows: Sequence[Sequence[str]], rules: Sequence[int] = ()) -> str:
    """A booktabs table; a rule goes above the rows whose numbers are listed."""
    lines = [r"\begin{tabular}{l" + "r" * (len(header) - 1) + "}", r"\toprule", " & ".join(header) + r" \\", r"\midrule"]
    for i, r in enumerate(rows):
        lines += [r"\midrule"] * (i in rules) + [" & ".join(r) + r" \\"]
    return "\n".join([*lines, r"\bottomrule", r"\end{tabular}", ""])


def regression_table(fits: Sequence[Fit], labels: Mapping[str, str], firms: int, industries: int) -> str:
    """Coefficients with stars above t statistics in brackets; cells of variables that a model lacks stay blank."""
    rows = []
    for name in dict.fromkeys(n for f in fits for n in f.names):
        at = [f.names.index(name) if name in f.names else None for f in fits]
        rows.append([labels.get(name, name), *("" if i is None else _num(f.params[i], 4) + _stars(f.pvalues[i]) for f, i in zip(fits, at))])
        rows.append(["", *("" if i is None else f"({_num(f.tstats[i], 2)})" for f, i in zip(fits, at))])
    rule = len(rows)
    rows += [["Observations", *(f"{f.nobs:,}" for f in fits)], ["Firms", *([f"{firms:,}"] * len(fits))], ["Industries", *([str(industries)] * len(fits))], ["Adj. $R^2$", *(_num(f.rsquared_adj) for f in fits)]]
    return _table(["", *(f"({i + 1})" for i in range(len(fits)))], rows, (rule,))


def comparison_table(ladder: DataFrame) -> str:
    """Adjusted R2, its gain, F of the added regressors with stars, AIC and BIC; ladder as ladder_table() gives it."""
    rows = [[r.model, _num(r.adj_r2), _num(r.gain), "" if r.f is None else _num(r.f, 2) + _stars(r.p), _num(r.aic, 1), _num(r.bic, 1)] for r in ladder.orderBy("step").collect()]
    return _table(["Model", "Adj. $R^2$", r"$\Delta$", "$F$", "AIC", "BIC"], rows)


def robustness_table(battery: DataFrame) -> str:
    """Coefficient with stars, t statistic, adjusted R2 and rows of each variant; battery as robustness.battery() gives it."""
    rows = [[r.variant, _num(r.coef, 4) + _stars(r.p), _num(r.t, 2), _num(r.adj_r2), f"{r.nobs:,}"] for r in battery.orderBy("position").collect()]
    return _table(["Variant", "Coefficient", "$t$", "Adj. $R^2$", "Observations"], rows)


def summary_table(stats: DataFrame, labels: Mapping[str, str]) -> str:
    """Mean, standard deviation and quartiles; stats as describe() gives them."""
    by = {r.variable: r for r in stats.collect()}
    return _table(["Variable", "Mean", "SD", "P25", "Median", "P75"], [[labels.get(v, v), *(_num(by[v][k]) for k in ("mean", "std", "p25", "p50", "p75"))] for v in labels if v in by])


def correlation_table(pairs: DataFrame, labels: Mapping[str, str]) -> str:
    """The lower triangle with stars; pairs as correlations_with_p() gives them."""
    found = {frozenset((r.variable, r.other)): r for r in pairs.collect()}
    names, rows = list(labels), []
    for i, a in enumerate(names):
        cells = [_num(found[frozenset((a, b))].r, 2) + _stars(found[frozenset((a, b))].p or 0.0 if found[frozenset((a, b))].p is not None else 1.0) for b in names[:i]]
        rows.append([f"({i + 1}) {labels[a]}", *cells, "1.00", *([""] * (len(names) - i - 1))])
    return _table(["", *(f"({i + 1})" for i in range(len(names)))], rows)


def write_text(spark, text: str, path: str) -> None:
    """One file on any file system that Spark writes."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
