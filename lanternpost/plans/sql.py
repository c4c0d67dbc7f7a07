"""SQL text for the comparison queries, spelled for DuckDB.

Only building blocks: each mirrors a column function in plain SQL and is written
independently of it.  Character classes are explicit because RE2 reads ``\\s``,
``\\w`` and ``\\b`` as ASCII.
"""

from __future__ import annotations

import re

BLANK = r"\t\n\x0b\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(q(v) if isinstance(v, str) else "NULL" if v is None else str(v) for v in values) + "]"


def pick(values, index: str) -> str:
    """Entry of a literal list at a zero-based index expression."""
    return f"({items(values)})[1 + ({index}) % {len(values)}]"


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[{BLANK}]+', ''), '[{BLANK}]+$', '')"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{BLANK}]+', ' ', 'g'))"


def words(c: str) -> str:
    return f"list_filter(string_split({squeeze(c)}, ' '), lambda w: w <> '')"


def word_count(c: str) -> str:
    return f"len({words(c)})"


def sentences(c: str) -> str:
    marked = rf"regexp_replace({squeeze(c)}, '([.!?]) ', '\1' || chr(30), 'g')"
    return f"list_filter(string_split({marked}, chr(30)), lambda s: s <> '')"


def word_set(c: str, ascii_only: bool = False) -> str:
    runs = f"regexp_extract_all(lower({c}), '[{WORD}]{{4,}}')"
    if ascii_only:
        runs = f"list_filter({runs}, lambda w: regexp_full_match(w, '[a-z]{{4,}}'))"
    return f"list_distinct({runs})"


def shared(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def lookup(table: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"


def contains_any(c: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(p)})" for p in phrases) + ")"


def re2(pattern: str) -> str:
    """The pattern with Unicode classes in place of RE2's ASCII shorthands."""

    def edge(m: re.Match) -> str:
        opens = re.match(r"[\w(\\]", pattern[m.end() :]) is not None
        return f"(?:{'^' if opens else '$'}|[^{WORD}])"

    out = re.sub(r"\\b", edge, pattern)
    out = re.sub(r"\[([^\]]*)\\s([^\]]*)\]", lambda m: f"[{m[1]}{BLANK}{m[2]}]", out)
    return out.replace(r"\s", f"[{BLANK}]").replace(r"\w", f"[{WORD}]").replace(r"\d", r"\p{Nd}")


def matches_any(c: str, patterns: list[str]) -> str:
    return f"regexp_matches({c}, {q('|'.join(f'(?:{re2(p)})' for p in patterns))})"


def unit(v: str) -> str:
    size = f"sqrt(list_sum(list_transform({v}, lambda x: x * x)))"
    return f"CASE WHEN {size} > 0 THEN list_transform({v}, lambda x: x / {size}) ELSE {v} END"


def dot(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


def with_ctes(parts: list[str], body: str) -> str:
    """One WITH clause from named parts."""
    recursive = "RECURSIVE " if any("UNION ALL" in p and "recursion" in p for p in parts) else ""
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + body


def encoded(name: str, source: str, key: str, text: str, dim: int = 64) -> list[str]:
    """CTEs ending in ``name`` (key, vec): the unit hashed bag of lower-case words of each row."""
    return [
        f"{name}_w AS (SELECT {key} AS k, unnest({words(f'lower({text})')}) AS w FROM {source})",
        f"{name}_b AS (SELECT k, ('0x' || substr(md5(w), 1, 8))::BIGINT % {dim} AS b, count(*)::DOUBLE AS n FROM {name}_w GROUP BY ALL)",
        f"{name}_n AS (SELECT k, sqrt(sum(n * n)) AS s FROM {name}_b GROUP BY k)",
        f"{name}_g AS (SELECT src.{key} AS k, d.b FROM {source} src, (SELECT unnest(range({dim})) AS b) d)",
        f"""{name} AS (SELECT g.k AS {key}, list(coalesce(b.n / z.s, 0.0::DOUBLE) ORDER BY g.b) AS vec
            FROM {name}_g g LEFT JOIN {name}_b b USING (k, b) LEFT JOIN {name}_n z USING (k) GROUP BY g.k)""",
    ]


def chunked(source: str, key: str, text: str, budget: int = 140, least: int = 20) -> list[str]:
    """CTEs ending in ``chunked`` (key, chunk_no, n_pieces, text) for every row of ``source``."""
    body = strip(f"coalesce({text}, '')")
    return [
        f"bodies AS (SELECT {key} AS k, {body} AS body FROM {source} WHERE length({body}) >= {least})",
        f"sent_lists AS (SELECT k, {sentences('body')} AS l FROM bodies)",
        "sents AS (SELECT k, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM sent_lists)",
        f"counted AS (SELECT k, s, i, {word_count('s')} AS n FROM sents)",
        f"""recursion AS (
            SELECT k, i, n AS held, 1 AS part FROM counted WHERE i = 1
            UNION ALL
            SELECT c.k, c.i, CASE WHEN r.held + c.n > {budget} THEN c.n ELSE r.held + c.n END,
                   CASE WHEN r.held + c.n > {budget} THEN r.part + 1 ELSE r.part END
            FROM recursion r JOIN counted c ON c.k = r.k AND c.i = r.i + 1)""",
        f"""packed AS (SELECT r.k, r.part, string_agg(c.s, ' ' ORDER BY c.i) AS piece
            FROM recursion r JOIN counted c USING (k, i) GROUP BY r.k, r.part
            HAVING length(string_agg(c.s, ' ' ORDER BY c.i)) >= {least})""",
        f"""alone AS (SELECT k, any_value(piece) AS piece FROM packed GROUP BY k
            HAVING count(*) = 1 AND {word_count('any_value(piece)')} > {2 * budget})""",
        f"alone_words AS (SELECT k, {words('piece')} AS w FROM alone)",
        f"""windows AS (SELECT k, pos, array_to_string(list_slice(w, pos + 1, pos + {budget}), ' ') AS piece
            FROM (SELECT k, w, unnest(range(0, len(w), {budget})) AS pos FROM alone_words))""",
        f"""pieces AS (
            SELECT k, part AS o, piece FROM packed WHERE k NOT IN (SELECT k FROM alone)
            UNION ALL SELECT k, pos AS o, piece FROM windows WHERE length(piece) >= {least})""",
        f"""chunked AS (SELECT k AS {key}, row_number() OVER (PARTITION BY k ORDER BY o) AS chunk_no,
            count(*) OVER (PARTITION BY k) AS n_pieces, piece AS text FROM pieces)""",
    ]
