"""Operator 5: secrets by patterns and by a battery of randomness tests.

Known forms (assignments to password-like names, access keys, long hexadecimal runs) are found by pattern. The
method adds strings that look random. A candidate is an unbroken run of 16 or more characters of base64 and its
variants with a letter, or a part of a run between characters that are often separators. Its encoding is the smallest alphabet it fits; on that alphabet three tests
ask whether it could be uniform random characters:

* chi-squared of the characters' counts,
* runs of characters of one class (digit, lower case, upper case, other),
* serial correlation of neighbouring characters' places in the alphabet.

The three two-sided p-values are combined as three times the smallest. Random strings have uniform p-values and words
very small ones. So in each class of lengths the strings with a p-value above 0.5 tell how many random ones
there are, and the report takes the smallest threshold at which at most ``FALSE_SHARE`` of the strings above it are
not among those (Storey's estimate, turned round). Short strings, on which the tests have little power, thereby need higher
p-values. The counts are over all documents. A class with too few random strings to tell has a fixed threshold.
Of candidates within each other the longest that is above its threshold is reported.

Everything is SQL expressions: spans of a text stay in its row, and only counts of 100 steps of p-values by length
class are aggregated.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilescope.llm.common import set_aside, written_once

KINDS = ("assign", "access", "hex", "random")
#: Most wrong strings among the reported ones of a length class, as estimated.
FALSE_SHARE = 0.1
#: Lengths at which a class of candidates starts, and fewest random strings that it must seem to hold.
LENGTHS, LEAST_RANDOM = (16, 20, 24, 32, 48, 64), 5
#: Thresholds of the classes in which fewer seem to be random: the longer the string, the more the tests can tell.
SPARSE_LEVELS = (0.1, 0.1, 0.05, 0.02, 0.02, 0.01)
STEPS = 100
#: Spans that are gathered before they join the others of a text.
GATHERED = 256
MARK = "[SECRET]"

# The patterns of the known forms, for Java's expressions.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_START = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"

#: Separators by which a run is cut into further candidates, each set of them in turn; base64 may hold most of them.
SEPARATORS = ("[=]", "[=/]", "[=/_-]")

_DIGITS, _LOWER, _UPPER = string.digits, string.ascii_lowercase, string.ascii_uppercase
#: Encodings from the smallest alphabet to the largest: a pattern for the whole string, and the alphabet.
ENCODINGS = (
    ("[0-9a-f]+", _DIGITS + "abcdef"),
    ("[0-9A-F]+", _DIGITS + "ABCDEF"),
    ("[A-Z2-7]+", _UPPER + "234567"),
    ("[0-9a-z]+", _DIGITS + _LOWER),
    ("[0-9A-Z]+", _DIGITS + _UPPER),
    ("[0-9A-Za-z]+", _DIGITS + _LOWER + _UPPER),
    (".+", _DIGITS + _LOWER + _UPPER + "+/_=-"),
)
_SPAN = "array<struct<start:int,kind:int,end:int,token:string>>"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _gathered(parts: str, merge: Callable[[str, str], tuple[str, str]]) -> str:
    """SQL for the spans that go out while an array is read in order, from the place where each element starts.

    ``merge`` takes the expressions of the state (with ``at``) and of the element, and gives those of the next place
    and of an array of spans. Spans are gathered in runs, so that a long array isn't copied with each of them.
    """
    none = f"cast(array() AS {_SPAN})"
    at, out = merge("acc", "p")
    step = f"(acc, p) -> named_struct('at', {at}, 'out', concat(acc.out, {out}))"
    inner = f"aggregate(slice(_a, 1 + {GATHERED} * i, {GATHERED}), named_struct('at', all.at, 'out', {none}), {step})"
    outer = (
        f"(all, i) -> element_at(transform(array({inner}), x -> named_struct('at', x.at, 'out',"
        f" if(size(x.out) > 0, concat(all.out, array(x.out)), all.out))), 1)"
    )
    runs = f"sequence(0, cast((size(_a) - 1) div {GATHERED} AS int))"
    whole = f"aggregate({runs}, named_struct('at', 0, 'out', cast(array() AS array<{_SPAN}>)), {outer}, x -> flatten(x.out))"
    return f"element_at(transform(array({parts}), _a -> {whole}), 1)"


def _found(kind: int, pattern: str, gate: str | None = None, least_group: int = 0) -> str:
    """SQL for the spans of leftmost matches in ``_text``, with starts and ends in code points.

    The text splits into what lies between matches; added up, the lengths of both are the places. With
    ``least_group`` matches stay only if their second group has that many characters.
    """
    quoted = _quoted(pattern)
    group = f"regexp_extract_all(_text, {quoted}, {2 if least_group else 0})"
    parts = f"arrays_zip(split(_text, {quoted}, -1), regexp_extract_all(_text, {quoted}, 0), {group})"

    def merge(acc: str, p: str) -> tuple[str, str]:
        between, match, inner = (f"{p}.`{i}`" for i in range(3))
        start = f"{acc}.at + length({between})"
        end = f"{start} + coalesce(length({match}), 0)"
        span = f"named_struct('start', {start}, 'kind', {kind}, 'end', {end}, 'token', {match})"
        keep = f"{match} IS NOT NULL AND length({inner}) >= {least_group}"
        return end, f"if({keep}, array({span}), cast(array() AS {_SPAN}))"

    return f"CASE WHEN _text RLIKE {_quoted(gate or pattern)} THEN {_gathered(parts, merge)} ELSE cast(array() AS {_SPAN}) END"


def _class_moments(alphabet: str) -> tuple[float, float]:
    """Sums of the squares and of the cubes of the shares of character classes in an alphabet."""
    sizes = [sum(c in group for c in alphabet) for group in (_DIGITS, _LOWER, _UPPER, "+/_=-")]
    return sum((n / len(alphabet)) ** 2 for n in sizes), sum((n / len(alphabet)) ** 3 for n in sizes)


def _encoding(token: str) -> str:
    """SQL for the encoding of a token: alphabet and the moments of its classes."""
    cases = "".join(
        f" WHEN {token} RLIKE '^{pattern}$' THEN named_struct('alphabet', '{alphabet}', 'k', {len(alphabet)},"
        f" 's2', {s2:.12f}D, 's3', {s3:.12f}D)"
        for pattern, alphabet in ENCODINGS
        for s2, s3 in [_class_moments(alphabet)]
    )
    return f"CASE{cases} END"


def p_value(z: str) -> str:
    """SQL for a two-sided normal p-value; the logistic form is within 0.0002."""
    return f"2 - 2 / (1 + exp(-1.5976D * abs({z}) - 0.07056D * power(abs({z}), 3)))"


def _tests() -> str:
    """SQL for a candidate ``t`` as (start, end, n, p): its span, length and combined p-value.

    ``t`` has token, n, its encoding e, and for each character its place in the alphabet (codes) and its class. A run
    ends where two neighbours differ in class. All sums are linear in the token's length.
    """
    squares = (
        "aggregate(split(t.e.alphabet, ''), 0D, (a, c) -> a + if(c = '', 0D,"
        " power(t.n - length(replace(t.token, c, '')), 2)))"
    )
    chi = f"({squares} * t.e.k / t.n - t.n - (t.e.k - 1)) / sqrt(2D * (t.e.k - 1) * (t.n - 1) / t.n)"

    def neighbours(of: str, joined: str) -> str:
        return f"zip_with(slice({of}, 1, t.n - 1), slice({of}, 2, t.n - 1), (x, y) -> {joined})"

    equal = f"aggregate({neighbours('t.classes', 'if(x = y, 1, 0)')}, 0, (a, x) -> a + x)"
    runs = (
        f"({equal} - (t.n - 1) * t.e.s2)"
        " / sqrt((t.n - 1) * t.e.s2 * (1 - t.e.s2) + 2 * (t.n - 2) * (t.e.s3 - t.e.s2 * t.e.s2))"
    )
    centred = "({} - (t.e.k + 1) / 2D)"
    products = f"aggregate({neighbours('t.codes', f'{centred.format("x")} * {centred.format("y")}')}, 0D, (a, x) -> a + x)"
    serial = f"{products} * 12 / ((t.e.k * t.e.k - 1) * sqrt(t.n - 1D))"
    least = ", ".join(p_value(f"({z})") for z in (chi, runs, serial))
    return f"named_struct('start', t.start, 'end', t.end, 'n', t.n, 'p', least(1D, 3 * least({least})))"


def _parts(separators: str) -> str:
    """SQL for the spans of the parts of the run ``r`` between separators."""

    def merge(acc: str, p: str) -> tuple[str, str]:
        start = f"r.start + {acc}.at"
        span = f"named_struct('start', {start}, 'kind', r.kind, 'end', {start} + length({p}), 'token', {p})"
        return f"{acc}.at + length({p}) + 1", f"if(length({p}) >= {LENGTHS[0]}, array({span}), cast(array() AS {_SPAN}))"

    return _gathered(f"split(r.token, '{separators}', -1)", merge)


def _candidates() -> str:
    """SQL for the tested candidates among the runs in ``_long`` and their parts."""
    every = ", ".join(_parts(x) for x in SEPARATORS)
    parts = f"if(r.token RLIKE '{SEPARATORS[-1]}', array_distinct(concat(array(r), {every})), array(r))"
    encoded = (
        f"transform(filter(flatten(transform(_long, r -> {parts})), x -> x.token RLIKE '[A-Za-z]'), x -> named_struct("
        f"'start', x.start, 'end', x.end, 'token', x.token, 'n', length(x.token), 'e', {_encoding('x.token')}))"
    )
    classes = f"translate(x.token, '{_DIGITS}{_LOWER}{_UPPER}+/_=-', '{'d' * 10}{'l' * 26}{'u' * 26}{'o' * 5}')"
    spelled = (
        f"transform({encoded}, x -> named_struct('start', x.start, 'end', x.end, 'token', x.token, 'n', x.n, 'e', x.e,"
        f" 'codes', transform(split(x.token, ''), c -> instr(x.e.alphabet, c)), 'classes', split({classes}, '')))"
    )
    return f"transform({spelled}, t -> {_tests()})"


def scan(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``_document``, a struct of the kept columns, with ``_base``, the spans of known forms in order, and
    ``_tested``, the tested candidates."""
    kept = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_document")
    return (
        docs.select(kept, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
        .withColumns(
            {
                "_base": F.expr(
                    f"array_sort(concat({_found(0, ASSIGN, ASSIGN_START, 8)}, {_found(1, ACCESS)}, {_found(2, HEX)}))"
                ),
                "_long": F.expr(_found(3, CANDIDATE)),
            }
        )
        .withColumn("_tested", F.expr(_candidates()))
        .drop("_text", "_long")
    )


def _length_class(n: str) -> str:
    return " + ".join(f"if({n} >= {least}, 1, 0)" for least in LENGTHS)


def thresholds(scanned: DataFrame, false_share: float = FALSE_SHARE) -> list[float]:
    """The p-value above which candidates of each length class are reported; the first, of what is too short, is 2."""
    step = f"least({STEPS - 1}, cast(floor(c.p * {STEPS}) AS int))"
    counts = (
        scanned.select(F.explode("_tested").alias("c"))
        .groupBy(F.expr(_length_class("c.n")).alias("class"), F.expr(step).alias("step"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()  # at most 600 rows
    )
    found = [2.0, *SPARSE_LEVELS]
    for number in range(1, len(found)):
        steps = [0] * STEPS
        for row in counts:
            if row["class"] == number:
                steps[row["step"]] = row["n"]
        # Three times the least of three p-values is not uniform near 1; below a half it is nearly so.
        random = sum(steps[STEPS // 2 :]) / _expected_above(0.5)
        if random < LEAST_RANDOM:
            continue
        for at in range(STEPS):
            above = sum(steps[at:])
            if above and 1 - random * _expected_above(at / STEPS) / above <= false_share:
                found[number] = at / STEPS
                break
    return found


def _expected_above(p: float) -> float:
    """Share of random strings whose combined p-value is at least ``p``, were the three tests independent."""
    return (1 - p / 3) ** 3


def find_secrets(
    docs: DataFrame, false_share: float = FALSE_SHARE, keep: Sequence[str] | None = None
) -> DataFrame:
    """Documents, or their columns in ``keep``, with ``secrets``: all spans (start, kind, end) in order of start and kind; ends are exclusive.

    Places are code points. Spans of known forms stay as they are; a random string that overlaps one of them is not
    reported again. Nulls: a null or empty text has no spans. Repeated rows have the same spans. An empty table
    gives no rows. A column ``secrets`` is replaced; other columns stay.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "secrets"]
    scanned = written_once(scan(docs, keep), "scanned")
    level = F.array(*[F.lit(x) for x in thresholds(scanned, false_share)])
    passed = F.expr(
        f"filter(_tested, c -> c.p >= element_at(_level, 1 + {_length_class('c.n')})"
        " AND NOT exists(_base, b -> b.start < c.end AND c.start < b.end))"
    )
    added = F.expr("filter(_passed, c -> NOT exists(_passed, d -> d.start <= c.start AND c.end <= d.end AND d.n > c.n))")
    spans = F.expr(
        "array_sort(concat(transform(_base, b -> named_struct('start', b.start, 'kind', b.kind, 'end', b.end)),"
        " transform(_added, c -> named_struct('start', c.start, 'kind', 3, 'end', c.end))))"
    )
    return (
        scanned.withColumn("_level", level)
        .withColumn("_passed", passed)
        .withColumn("_added", added)
        .withColumn("secrets", spans)
        .select("_document.*", "secrets")
    )


def _listed(spans: str) -> str:
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, s -> concat(element_at({kinds}, s.kind + 1), ':', s.start, ':', s.end)), ',')"


def op5(docs: DataFrame) -> DataFrame:
    """The contract's counts and digests of the spans."""
    found = find_secrets(docs.withColumn("doc_id", F.col("doc_id").cast("long")), keep=["doc_id"])

    def count(kind: int) -> Column:
        return F.expr(f"cast(size(filter(secrets, s -> s.kind = {kind})) AS bigint)")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.expr(_listed("filter(secrets, s -> s.kind < 3)")), 256).alias("base_sha256"),
        F.expr(_listed("secrets")).alias("spans"),
        count(3).alias("n_random"),
    )


def redact(docs: DataFrame, false_share: float = FALSE_SHARE, mark: str = MARK) -> DataFrame:
    """Documents in whose texts every secret is replaced by ``mark``; overlapping spans become one.

    ``n_chars``, if there, is that of the new text where the text changed. All columns stay, of any name.
    """
    counted = [c for c in ("n_chars",) if c in docs.columns]
    bare, columns = set_aside(docs, "text", *counted)
    found = find_secrets(bare, false_share)
    cut = (
        "aggregate(secrets, named_struct('at', 0, 'out', ''), (acc, s) -> CASE"
        " WHEN s.end <= acc.at THEN acc"
        " WHEN s.start < acc.at THEN named_struct('at', s.end, 'out', acc.out)"
        f" ELSE named_struct('at', s.end, 'out', concat(acc.out, substring(text, acc.at + 1, s.start - acc.at), {_quoted(mark)}))"
        " END, acc -> concat(acc.out, substring(text, acc.at + 1)))"
    )
    hit = F.size("secrets") > 0
    clean = found.withColumn("text", F.when(hit, F.expr(cut)).otherwise(F.col("text")))
    if counted:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(hit, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean.select(*columns)
