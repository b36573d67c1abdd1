"""One SQL text for two engines: the few constructs that differ are written NAME[...] and rendered for each."""

from __future__ import annotations

import re

#: White space as Python's split() has it.
SPACE = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: ASCII punctuation as a SQL expression; quote and backslash by number, since engines differ in their escapes.
PUNCTUATION = "'!\"#$%&()*+,-./:;<=>?@[]^_`{{|}}~' || chr(39) || chr(92)"

#: Characters whose capital is one other character only by the simple mapping, with those capitals.
_SMALL = "ß" + "".join(chr(c) for row in (0x1F80, 0x1F90, 0x1FA0) for c in range(row, row + 8)) + "\u1fb3\u1fc3\u1ff3"
_CAPITAL = "\u1e9e" + "".join(chr(ord(c) + 8) for c in _SMALL[1:25]) + "\u1fbc\u1fcc\u1ffc"

#: name -> (Spark, DuckDB); $1, $2, ... are the arguments.
FORMS = {
    "TOKENS": ("filter(split(lower($1), '[^a-z0-9]+'), t -> t <> '')", "list_filter(regexp_split_to_array(lower($1), '[^a-z0-9]+'), lambda t: t <> '')"),
    "WORDS": (f"filter(split(lower($1), '[{SPACE}]+'), t -> t <> '')", f"list_filter(regexp_split_to_array(lower($1), '[{SPACE}]+'), lambda t: t <> '')"),
    "NO_ARTICLES": (f"array_join(filter(split($1, '[{SPACE}]+'), t -> t not in ('', 'a', 'an', 'the')), ' ')", f"array_to_string(list_filter(regexp_split_to_array($1, '[{SPACE}]+'), lambda t: t not in ('', 'a', 'an', 'the')), ' ')"),
    # a character for a character, as DuckDB has it; Spark's own upper makes two of a sharp s
    "UPPER": (f"array_join(transform(split($1, ''), c -> CASE WHEN length(upper(c)) > 1 THEN translate(c, '{_SMALL}', '{_CAPITAL}') ELSE upper(c) END), '')", "upper($1)"),
    "PLAIN": (f"translate(lower($1), {PUNCTUATION}, '')", f"translate(lower($1), {PUNCTUATION}, '')"),
    "RR": ("regexp_replace($1, $2, $3)", "regexp_replace($1, $2, $3, 'g')"),
    "DOT": ("round(aggregate(zip_with($1, $2, (x, y) -> cast(x AS DOUBLE) * y), cast(0 AS DOUBLE), (s, v) -> s + v), 6)", "round(list_dot_product($1::DOUBLE[], $2::DOUBLE[]), 6)"),
    "VADD": ("zip_with($1, $2, (x, y) -> cast(x AS DOUBLE) + y)", "list_transform(list_zip($1, $2), lambda z: z[1]::DOUBLE + z[2])"),
    "PAT": ("r$1", "$1"),
    "FOUND": ("regexp_extract_all($1, $2, 0)", "regexp_extract_all($1, $2)"),
    "SHA": ("sha2($1, 256)", "sha256($1)"),
    "SIZE": ("size($1)", "len($1)"),
    "COMMON": ("size(array_intersect($1, $2))", "len(list_intersect($1, $2))"),
    "EITHER": ("size(array_union($1, $2))", "len(list_distinct(list_concat($1, $2)))"),
    "DISTINCT_OF": ("array_distinct($1)", "list_distinct($1)"),
    "FIRST_N": ("slice($1, 1, $2)", "($1)[1:$2]"),
    "JOINED": ("array_join($1, $2)", "array_to_string($1, $2)"),
    "PAGE_ID": ("format_string('%s_p%04d', cast($1 AS STRING), cast($2 AS INT))", "printf('%s_p%04d', ($1)::VARCHAR, ($2)::INT)"),
    "TEXT": ("cast($1 AS STRING)", "($1)::VARCHAR"),
    "LONG": ("cast($1 AS BIGINT)", "($1)::BIGINT"),
    "REAL": ("cast($1 AS DOUBLE)", "($1)::DOUBLE"),
    "ORDERED": ("array_join(transform(array_sort(collect_list(struct($2 AS o, $1 AS v))), z -> z.v), $3)", "string_agg($1, $3 ORDER BY $2)"),
    "MATCHES": ("$1 rlike $2", "regexp_matches($1, $2)"),
    "IDIV": ("cast(floor(($1) / ($2)) AS BIGINT)", "(($1) // ($2))::BIGINT"),
    # of bytes, as DuckDB counts them
    "LEV": ("levenshtein(decode(encode($1, 'UTF-8'), 'ISO-8859-1'), decode(encode($2, 'UTF-8'), 'ISO-8859-1'))", "levenshtein($1, $2)"),
    "HAS": ("contains($1, $2)", "contains($1, $2)"),
    "UWORDS": ("regexp_extract_all(lower($1), r'[\\p{{L}}\\p{{N}}_]+', 0)", "regexp_extract_all(lower($1), '[\\p{{L}}\\p{{N}}_]+')"),
    "LISTED": ("collect_list($1)", "list($1)"),
    "NO_STRINGS": ("slice($1, 1, 0)", "($1)[1:0]"),
    "ELEMENT": ("try_element_at($1, $2)", "($1)[$2]"),
    "COUNT_OF": ("regexp_count($1, $2)", "len(regexp_extract_all($1, $2))"),
}


def _arguments(s: str, at: int) -> tuple[list[str], int]:
    """The arguments from the bracket at place `at` on, split at top-level semicolons, and the place after it."""
    depth, quoted, out, start = 0, False, [], at + 1
    for i in range(at, len(s)):
        c = s[i]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
            if depth == 0:
                return [*out, s[start:i].strip()], i + 1
        elif c == ";" and depth == 1:
            out.append(s[start:i].strip())
            start = i + 1
    raise ValueError("open bracket")


_NAME = re.compile(r"\b(" + "|".join(sorted(FORMS, key=len, reverse=True)) + r")\[")


def render(sql: str, engine: int) -> str:
    """engine 0: Spark, 1: DuckDB."""
    while m := _NAME.search(sql):
        args, end = _arguments(sql, m.end() - 1)
        form = FORMS[m[1]][engine]
        for k in range(len(args), 0, -1):
            form = form.replace(f"${k}", args[k - 1])
        sql = sql[: m.start()] + form + sql[end:]
    return sql
