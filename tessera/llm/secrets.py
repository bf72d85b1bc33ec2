"""Secret scans (native: DataFrame and SQL functions only).

Patterns find assignments, access keys and long hexadecimal runs. Beside them, long
mixed tokens pass a randomness test battery against the alphabet of their inferred
encoding: chi-squared uniformity, runs, and serial correlation. Within each length band
a false-discovery control decides which tokens are too regular; the others are reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, stage

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "random")
#: Alphabets, smallest first; the first that holds a token's characters is its encoding.
ALPHABETS = (("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
             ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"))
#: False-discovery rate, and steps of the p-value histogram per factor of ten.
RATE, STEPS, MOST = 0.05, 50, 1000

SPAN = "struct<start: bigint, kind: int, stop: bigint>"


#: Matches whose lengths are summed at once.
RUN = 128


def found(text: str, pattern: str) -> str:
    """SQL for array<struct<start, stop, value>> of a pattern's leftmost non-overlapping
    matches (never empty) in code points: gaps and matches alternate, so starts are sums.
    They are summed by runs of RUN matches, so the work grows little faster than the matches.
    Arrays of one struct bind what is evaluated once."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    none = "cast(array() as array<struct<start: bigint, stop: bigint, value: string>>)"
    return f"""if({text} rlike '{p}', flatten(transform(transform(transform(
        array(named_struct('gaps', split({text}, '{p}', -1), 'values', regexp_extract_all({text}, '{p}', 0))),
        s -> named_struct('values', s.values, 'gaps', transform(slice(s.gaps, 1, size(s.values)), g -> cast(length(g) as bigint)),
          'steps', transform(s.values, (v, i) -> cast(length(s.gaps[i]) + length(v) as bigint)))),
        s -> named_struct('values', s.values, 'gaps', s.gaps, 'steps', s.steps,
          'sums', aggregate(sequence(0, (size(s.values) - 1) div {RUN}), array(0L), (a, i) -> array_append(a, a[size(a) - 1] + aggregate(slice(s.steps, cast(i * {RUN} + 1 as int), {RUN}), 0L, (x, y) -> x + y))))),
        s -> transform(s.values, (v, i) -> transform(array(s.sums[i div {RUN}] + s.gaps[i] + aggregate(slice(s.steps, cast(i div {RUN} * {RUN} + 1 as int), i % {RUN}), 0L, (x, y) -> x + y)),
          at -> named_struct('start', at, 'stop', at + length(v), 'value', v))[0]))), {none})"""


def upper_tail(z: str) -> str:
    """SQL for the normal distribution's upper tail (Abramowitz and Stegun 26.2.17), at least 1e-30."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    poly = f"({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    tail = f"(exp(-{z} * {z} / 2) * 0.3989422804014327 * {poly})"
    return f"greatest(1e-30D, if({z} >= 0, {tail}, 1 - {tail}))"


def battery(token: str = "v") -> list[str]:
    """SQL steps as (name, expression) over a token: alphabet, codes, p-value."""
    cases = " ".join(f"when {token} rlike '^[{a.replace('-', '') + ('-' if '-' in a else '')}]+$' then '{a}'" for _, a in ALPHABETS)
    return [
        ("a", f"case {cases} else '{ALPHABETS[-2][1]}' end"),
        ("n", f"cast(length({token}) as double)"),
        ("k", "cast(length(a) as double)"),
        ("c", f"transform(filter(split({token}, ''), ch -> ch <> '' and instr(a, ch) > 0), ch -> cast(instr(a, ch) - 1 as double))"),
        ("x", f"aggregate(split(a, ''), 0D, (s, ch) -> if(ch = '', s, s + power(length({token}) - length(replace({token}, ch, '')) - n / k, 2) * k / n))"),
        ("chi", "(x - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n)"),
        ("ones", "cast(size(filter(c, v -> v * 2 >= k)) as double)"),
        ("runs", "1D + size(filter(transform(slice(c, 2, size(c)), (v, i) -> (v * 2 >= k) <> (c[i] * 2 >= k)), d -> d))"),
        ("mu", "2 * ones * (size(c) - ones) / size(c) + 1"),
        ("run", "if(mu <= 2, 20D, (runs - mu) / sqrt((mu - 1) * (mu - 2) / (size(c) - 1)))"),
        ("avg", "aggregate(c, 0D, (s, v) -> s + v) / size(c)"),
        ("var", "aggregate(c, 0D, (s, v) -> s + (v - avg) * (v - avg))"),
        ("cov", "aggregate(transform(slice(c, 2, size(c)), (v, i) -> (v - avg) * (c[i] - avg)), 0D, (s, v) -> s + v)"),
        ("ser", "if(var = 0, 20D, (cov / var + 1 / n) * sqrt(n))"),
        ("p", f"least(1D, 3 * least({upper_tail('chi')}, 2 * {upper_tail('abs(run)')}, 2 * {upper_tail('abs(ser)')}))"),
    ]


def p_values(tokens: DataFrame) -> DataFrame:
    """tokens(v, ...) with the battery's steps, p the combined (Bonferroni) p-value."""
    for name, sql in battery():
        tokens = tokens.withColumn(name, F.expr(sql))
    return tokens


def _spans(docs: DataFrame, carry: tuple[str, ...]) -> tuple[DataFrame, str]:
    """The ``carry`` columns of docs and the spans, under a name of its own."""
    row, text, base, tokens, more = (free_name(docs, c) for c in ("row", "body", "base", "tokens", "more"))
    body = docs.select(*carry, F.monotonically_increasing_id().alias(row), F.coalesce(F.col("text").cast("string"), F.lit("")).alias(text))
    assigned = F.expr(f"filter({found(text, ASSIGN)}, x -> length(regexp_extract(x.value, '{_sql(ASSIGN)}', 2)) >= 6)")
    kinds = [assigned, F.expr(found(text, ACCESS)), F.expr(found(text, HEX))]
    spans = [F.transform(k, _of_kind(i)) for i, k in enumerate(kinds)]
    mixed = F.expr(f"filter({found(text, TOKEN)}, x -> x.value rlike '[0-9]' and x.value rlike '[A-Za-z]')")
    rows = stage(body.select(row, *carry, F.array_sort(F.concat(*spans)).alias(base), mixed.alias(tokens)), "secrets")
    free = rows.where(F.size(tokens) > 0).select(F.col(row).alias("row"), F.expr(f"explode(filter({tokens}, t -> not exists({base}, b -> b.start < t.stop and t.start < b.stop)))").alias("t"))
    tested = p_values(free.select("row", "t.start", "t.stop", F.col("t.value").alias("v")))
    step = F.least(F.floor(-F.log10("p") * STEPS), F.lit(MOST)).cast("int")
    tested = stage(tested.select("row", "start", "stop", F.floor(F.log2("n")).cast("int").alias("band"), step.alias("step")), "secret-tokens")
    limits = thresholds(tested)
    odd = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for b in limits for x in (b, limits[b])]), F.col("band")), F.lit(MOST + 1)) if limits else F.lit(MOST + 1)
    kept = tested.where(F.col("step") < odd).groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "stop")).alias(more))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    return rows.join(kept, row, "left").select(*carry, F.array_sort(F.concat(base, F.coalesce(more, none))).alias(base)), base


def scan(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of docs(text, ...): the ``carry`` columns and ``all_spans``, an array of
    (start, kind, stop) by start and kind, of whole texts; kind indexes KINDS.

    A null text is empty and has none; repeated rows are each returned and each counted
    in the false-discovery control; an empty table gives no rows. Random spans that
    touch a pattern's span are left to it.
    """
    rows, spans = _spans(docs, carry)
    return rows.select(*carry, F.col(spans).alias("all_spans"))


def thresholds(tested: DataFrame) -> dict[int, int]:
    """By length band, the histogram step from which tokens are too regular to be random:
    Benjamini-Hochberg at RATE over the band, on the upper edges of p-value steps.
    The histogram has at most MOST + 1 rows a band, whatever the corpus."""
    counts: dict[int, dict[int, int]] = {}
    for r in tested.groupBy("band", "step").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["band"], {})[r["step"]] = r["n"]
    limits = {}
    for band, steps in counts.items():
        total, above = sum(steps.values()), 0
        for s in sorted(steps, reverse=True):
            above += steps[s]
            if 10 ** (-s / STEPS) <= RATE * above / total:
                limits[band] = s
    return limits


def _of_kind(kind: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["stop"].alias("stop"))


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def listed(spans: str, most: int = 3) -> str:
    """SQL for kind:start:end of the spans whose kind is at most ``most``, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform(filter({spans}, x -> x.kind <= {most}), x -> concat(array({names})[x.kind], ':', x.start, ':', x.stop)), ',')"


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts by pattern, digest of the pattern spans, and all spans."""
    rows = scan(docs)
    count = [F.expr(f"cast(size(filter(all_spans, x -> x.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *count[:3], F.sha2(F.expr(listed("all_spans", 2)), 256).alias("base_sha256"), F.expr(listed("all_spans")).alias("spans"), count[3])


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs, with its own columns whatever their names, each found span replaced by ``mark``."""
    rows, spans = _spans(docs, tuple(docs.columns))
    # Spans ascend, so text is copied up to each span once; a span inside an earlier one adds nothing.
    text = F.expr(f"""aggregate({spans}, named_struct('out', '', 'at', 0L),
        (s, x) -> if(x.start >= s.at, named_struct('out', concat(s.out, substring(text, cast(s.at + 1 as int), cast(x.start - s.at as int)), '{mark}'), 'at', x.stop),
                     named_struct('out', s.out, 'at', greatest(s.at, x.stop))),
        s -> concat(s.out, substring(text, cast(s.at + 1 as int))))""")
    return rows.withColumn("text", text).select(*docs.columns)
