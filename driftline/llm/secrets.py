"""Secret scans in DataFrame operations only.

Three fixed kinds come from patterns. The fourth, `entropy`, comes from
candidate strings: runs of 20 and more characters of one class. A window of 20
characters slides over a candidate; the counts of its characters change by one
that enters and one that leaves, and with them the sum of n * log2(n), so each
step costs the same whatever the window. Where fixed spans cover a part of a
candidate, the parts they leave over are the candidates. One whose best window
reaches its class's threshold is a secret, unless the allow list names its form.

A match's place is the length of all pieces and matches before it; pieces come
from split(), matches from regexp_extract_all(), which find the same matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sqltext import let, lit

# The patterns of the three fixed kinds and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE_MIN = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Class of a whole candidate, and bits that its best window must reach; 99 % of random base64 strings of one window reach 3.6.
CLASSES = (("^[0-9a-fA-F]+$", 3.0), ("^[A-Za-z0-9]+$", 3.7), ("^[A-Za-z0-9+/_=-]+$", 3.6))
#: Forms that are no secrets: only letters, only digits, words joined by - or _, ids of numbers and words, dates with times, UUIDs, paths of words, rules, placeholders.
ALLOWED = (
    "^[A-Za-z]+$",
    "^[0-9]+$",
    "^[A-Za-z]+([-_][A-Za-z]+)+$",
    "^[A-Za-z]{0,8}[0-9]{1,4}([-_/]([0-9]{1,12}|[A-Z]?[a-z]{1,12}))+$",
    "^[0-9]{4}[-_/][0-9]{2}[-_/][0-9]{2}T[0-9]{2}([-_]?[0-9]{2}){0,2}([-_+][0-9]{2,6})?Z?$",
    "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    "^/?([A-Za-z_-]+/)+[A-Za-z_-]*$",
    r"^(.)\1+$",
    "(?i)(example|placeholder|changeme|dummy|xxxxxx|abcdefgh|01234567)",
)
_BLOCK = 256


def _running(array: str) -> str:
    """Sums of all elements before each one, in blocks: the cost stays near linear for long arrays."""
    local = f"transform(sequence(0, cast(floor((size(xs) - 1) / {_BLOCK}) as int)), b -> aggregate(slice(xs, b * {_BLOCK} + 1, {_BLOCK}), array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x))))"
    ends = "aggregate(bs, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + element_at(x, -1))))"
    body = let("bs", local, let("es", ends, "flatten(transform(bs, (x, b) -> transform(slice(x, 1, size(x) - 1), y -> y + es[b])))"))
    return let("xs", array, f"if(size(xs) = 0, array(), {body})")


def _found(pattern: str, kind: str, keep: str) -> str:
    """Spans (start, rank, end, kind, value) of a pattern's matches in `t` that pass keep (of m, the match, and i, its place)."""
    p = lit(pattern)
    lengths = "transform(ms, (m, i) -> cast(length(ps[i]) + length(m) as long))"
    body = let(
        "ps",
        f"split(t, {p}, -1)",
        let(
            "ss",
            _running(lengths),
            "filter(transform(ms, (m, i) -> named_struct('start', ss[i] + length(ps[i]), 'rank', {rank}, 'end', ss[i] + length(ps[i]) + length(m), 'kind', '{kind}', 'value', m)), x -> {keep})".format(rank=KINDS.index(kind), kind=kind, keep=keep),
        ),
    )
    empty = "cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>)"
    return let("ms", f"regexp_extract_all(t, {p}, 0)", f"if(size(ms) = 0, {empty}, {body})")


def _best_entropy(value: str) -> str:
    """The highest Shannon entropy, in bits, of a window over the characters of value."""
    weight = "array(" + ", ".join("0D" if n < 1 else f"{n} * log2({n}D)" for n in range(WINDOW + 2)) + ")"
    step = (
        "named_struct("
        "'n', transform(a.n, (c, k) -> c + if(k = cs[i], 1, 0) - if(i >= {w} and k = cs[i - {w}], 1, 0)), "
        "'s', a.s + if(i >= {w} and cs[i - {w}] = cs[i], 0D, fs[a.n[cs[i]] + 1] - fs[a.n[cs[i]]] + if(i >= {w}, fs[a.n[cs[i - {w}]] - 1] - fs[a.n[cs[i - {w}]]], 0D)), "
        "'low', a.low)"
    ).format(w=WINDOW)
    least = "named_struct('n', z.n, 's', z.s, 'low', if(i >= {w1}, least(z.low, z.s), z.low))".format(w1=WINDOW - 1)
    scan = "aggregate(sequence(0, size(cs) - 1), named_struct('n', array_repeat(0, 128), 's', 0D, 'low', 1000D), (a, i) -> " + let("z", step, least) + f", a -> log2({WINDOW}D) - a.low / {WINDOW})"
    return let("cs", f"transform(filter(split({value}, ''), y -> y <> ''), y -> ascii(y))", let("fs", weight, scan))


def _secret(value: str) -> str:
    allowed = " or ".join(f"rlike({value}, {lit(p)})" for p in ALLOWED)
    need = "case " + " ".join(f"when rlike({value}, {lit(p)}) then {bits}D" for p, bits in CLASSES) + " else 99D end"
    return f"(not ({allowed}) and {_best_entropy(value)} >= {need})"


def _left_over() -> str:
    """The parts of candidate x, of a window and more, that no span of base covers: x itself where none does."""
    part = "named_struct('start', {a}, 'rank', x.rank, 'end', {b}, 'kind', x.kind, 'value', substring(x.value, cast({a} - x.start + 1 as int), cast({b} - {a} as int)))"
    step = "named_struct('pos', greatest(a.pos, y.end), 'out', if(y.start > a.pos, concat(a.out, array({})), a.out))".format(part.format(a="a.pos", b="y.start"))
    last = "if(x.end > a.pos, concat(a.out, array({})), a.out)".format(part.format(a="a.pos", b="x.end"))
    none = "cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>)"
    cut = f"filter(aggregate(hits, named_struct('pos', x.start, 'out', {none}), (a, y) -> {step}, a -> {last}), z -> z.end - z.start >= {WINDOW})"
    return let("hits", "filter(base, y -> y.start < x.end and x.start < y.end)", f"if(size(hits) = 0, array(x), {cut})")


def spans_expr(text_col: str) -> str:
    """SQL for the array of spans (start, rank, end, kind, value) of a text, by start and then kind."""
    assign = _found(ASSIGN, "assign", f"length(regexp_extract(x.value, {lit(ASSIGN)}, 2)) >= {ASSIGN_VALUE_MIN}")
    fixed = f"concat({assign}, {_found(ACCESS, 'access', 'true')}, {_found(HEX, 'hex', 'true')})"
    more = f"filter(flatten(transform({_found(CANDIDATE, 'entropy', 'true')}, x -> {_left_over()})), x -> {_secret('x.value')})"
    return let("t", f"coalesce({text_col}, '')", let("base", f"sort_array({fixed})", f"sort_array(concat(base, {more}))"))


def scan(df: DataFrame, text_col: str = "text", spans_col: str = "secrets") -> DataFrame:
    """df with spans_col: array of (start, rank, end, kind, value), by start and then kind.

    start and end count code points, the end is exclusive. A null or empty
    text has an empty array. Other columns stay; spans_col replaces a column of
    its name.
    """
    return df.withColumn(spans_col, F.expr(spans_expr(f"`{text_col}`")))


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with each span of text_col, spans that overlap as one, replaced by mark; null stays null."""
    step = (
        "if(x.end <= a.pos, a, named_struct('pos', x.end, 'out', "
        f"if(x.start < a.pos, a.out, concat(a.out, substring(tt, cast(a.pos + 1 as int), cast(x.start - a.pos as int)), {lit(mark)}))))"
    )
    done = "aggregate(sp, named_struct('pos', 0L, 'out', ''), (a, x) -> " + step + ", a -> concat(a.out, substring(tt, cast(a.pos + 1 as int), 2147483647)))"
    whole = let("tt", f"`{text_col}`", let("sp", spans_expr("tt"), f"if(size(sp) = 0, tt, {done})"))
    return df.withColumn(text_col, F.expr(whole))
