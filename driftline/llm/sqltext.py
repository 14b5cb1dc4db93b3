"""SQL fragments over texts, words and lines, for operators without Python on the executors."""

from __future__ import annotations

#: White space that parts words, inside a Java character class.
BLANKS = r"\x20\x09-\x0D"


def lit(text: str) -> str:
    """A SQL string literal of exactly this text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """body with name bound to value, which is computed once for each row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def words(text: str) -> str:
    """The words of a text that is not null."""
    return f"array_remove(split({text}, {lit(f'[{BLANKS}]+')}, -1), '')"


def word_lines(text: str) -> str:
    r"""The \n-split lines that have a word."""
    return f"filter(split({text}, '\\n', -1), l -> l rlike {lit(f'[^{BLANKS}]')})"


def count_of(text: str, chars: str) -> str:
    """How many characters of a Java character class a text has."""
    return f"(length({text}) - length(regexp_replace({text}, {lit(f'[{chars}]')}, '')))"


def words_in_repeats(ws: str, n: int) -> str:
    """Words that lie in an n-word window which the words ws hold twice or more, as bigint.

    Windows are compared by 64-bit hashes. First one sort of plain longs, whose
    low bits give way to the position, brings together all that can be equal;
    then the whole hashes of those are sorted with their positions.
    """
    grams = ", ".join(f"hs[i + {j}]" for j in range(n))
    same = lambda i, j: f"shiftrightunsigned({i}, p) = shiftrightunsigned({j}, p)"
    twin = lambda array, equal: f"filter({array}, (x, i) -> (i > 0 and {equal(f'{array}[i - 1]')}) or (i < size({array}) - 1 and {equal(f'{array}[i + 1]')}))"
    covered = f"aggregate(ps, named_struct('n', 0L, 'last', -{n}L), (a, x) -> named_struct('n', a.n + least({n}L, x - a.last), 'last', x), a -> a.n)"
    maybe = f"transform({twin('so', lambda other: same('x', other))}, x -> x & (shiftleft(1L, p) - 1L))"
    repeated = let(
        "p",
        "cast(ceil(log2(size(gs) + 1)) as int)",
        let(
            "so",
            "sort_array(transform(gs, (g, i) -> shiftleft(shiftrightunsigned(g, p), p) | cast(i as bigint)))",
            let(
                "hp",
                f"sort_array(transform({maybe}, i -> named_struct('g', gs[cast(i as int)], 'i', i)))",
                let("ps", f"sort_array(transform({twin('hp', lambda other: f'x.g = {other}.g')}, x -> x.i))", covered),
            ),
        ),
    )
    body = let("gs", f"transform(sequence(0, size(hs) - {n}), i -> xxhash64({grams}))", f"if(size(array_distinct(gs)) = size(gs), 0L, {repeated})")
    return let("hs", f"transform({ws}, w -> xxhash64(w))", f"if(size(hs) < {n + 1}, 0L, {body})")
