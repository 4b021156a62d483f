"""SQL that must give the same rows as queries of this subpackage, by brute force over whole tables."""

from __future__ import annotations

from tkanyna.llm.words import APOSTROPHES, CYRILLIC, GREEK, GREEK_CYRILLIC, GREEK_LATIN, LATIN

# A word as a reader sees it: look-alikes are read in the alphabet of the letters that only one alphabet has.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")


def _words(text: str) -> str:
    """The words of a text in lower case, as a list."""
    bare = f"regexp_replace(nfc_normalize({text}), '[\\x{{AD}}\\x{{34F}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{2066}}-\\x{{2069}}\\x{{FEFF}}\\x{{FE00}}-\\x{{FE0F}}\\x{{301}}]', '', 'g')"
    plain = f"regexp_replace(nfc_normalize(translate({bare}, '{WIDE}', '{NARROW}')), '[{APOSTROPHES}]', '''', 'g')"
    tokens = f"regexp_extract_all({plain}, '[\\p{{L}}\\p{{N}}]+(?:''[\\p{{L}}\\p{{N}}]+)*')"
    cyrillic = f"regexp_matches(translate(t, '{CYRILLIC}', ''), '[Ѐ-ԯ]')"
    latin = f"regexp_matches(translate(t, '{LATIN}', ''), '[a-zA-ZÀ-ɏ]')"
    read = f"CASE WHEN {latin} AND {cyrillic} THEN t WHEN {latin} THEN translate(t, '{CYRILLIC}{GREEK}', '{LATIN}{GREEK_LATIN}') ELSE translate(t, '{LATIN}{GREEK}', '{CYRILLIC}{GREEK_CYRILLIC}') END"
    return f"list_transform({tokens}, lambda t: lower({read}))"


def _near(left: str, right: str, field: str, on: str) -> str:
    """Pairs (a, b) of rows of two tables (id, words) whose sets of words are near-same."""
    token = "SELECT id, n, unnest({0}) AS w FROM (SELECT *, len({0}) AS n FROM {1}) WHERE n >= 8"
    return f"""SELECT a, b FROM (SELECT x.id AS a, y.id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS c FROM ({token.format(field, left)}) x JOIN ({token.format(field, right)}) y ON x.w = y.w AND {on} GROUP BY ALL)
        WHERE 10 * c >= 7 * (n + m - c)"""


def oracle_sql() -> dict[str, str]:
    sentences = f"s AS MATERIALIZED (SELECT sent_id AS id, list_distinct({_words('text')}) AS ws FROM standard_ukrainian WHERE text IS NOT NULL)"
    near = f"pairs AS MATERIALIZED ({_near('s', 's', 'ws', 'x.id < y.id')})"
    splits = f"""w AS MATERIALIZED (SELECT pair_id AS id, coalesce(split = 'train', false) AS train, list_distinct({_words('source')}) AS one, list_distinct({_words('target')}) AS other FROM parallel_pairs WHERE source IS NOT NULL AND target IS NOT NULL),
        tests AS (SELECT * FROM w WHERE NOT train), trains AS (SELECT * FROM w WHERE train), hits AS MATERIALIZED (SELECT * FROM ({_near('tests', 'trains', 'one', 'true')}) INTERSECT SELECT * FROM ({_near('tests', 'trains', 'other', 'true')}))"""
    running = "SELECT {0}, array_to_string(list_slice(ws, i, i + {1}), ' ') AS g FROM (SELECT {0}, ws, unnest(range(1, len(ws) - {1} + 1)) AS i FROM {2})"
    leaks = f"d AS (SELECT doc_id, {_words('text')} AS ws FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, {_words('text')} AS ws FROM eval_items WHERE text IS NOT NULL), found AS MATERIALIZED (SELECT DISTINCT doc_id, item_id FROM ({running.format('doc_id', 11, 'd')}) JOIN ({running.format('item_id', 11, 'e')}) USING (g))"
    fields = " UNION ALL ".join(f"SELECT pair_id, coalesce(split = 'train', false) AS train, '{f}' AS field, {_words(f)} AS ws FROM parallel_pairs WHERE {f} IS NOT NULL" for f in ("source", "target"))
    return {
        "p1_found": f"WITH {sentences}, {near} SELECT a AS sent_id_a, b AS sent_id_b FROM pairs",
        "p1_groups": f"""WITH RECURSIVE {sentences}, {near}, both_ways AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
            reached AS (SELECT a, b FROM both_ways UNION SELECT r.a, x.b FROM reached r JOIN both_ways x ON r.b = x.a)
            SELECT sent_id, least(sent_id, coalesce((SELECT min(b) FROM reached WHERE a = sent_id), sent_id)) AS group_id, (SELECT count(*) FROM both_ways WHERE a = sent_id) AS links FROM standard_ukrainian""",
        "p3_found": f"WITH {splits} SELECT least(a, b) AS pair_id_a, greatest(a, b) AS pair_id_b FROM hits",
        "p3_report": f"""WITH {splits}, many AS (SELECT a, count(*) AS n FROM hits GROUP BY 1) SELECT split, origin, count(*) AS rows, count(n) AS overlapping, coalesce(sum(n), 0)::BIGINT AS train_matches
            FROM parallel_pairs LEFT JOIN many ON pair_id = a WHERE split IS DISTINCT FROM 'train' GROUP BY ALL""",
        "p3_coverage": f"""WITH t AS MATERIALIZED ({fields}), runs AS MATERIALIZED (SELECT pair_id, train, field, len(ws) AS n, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS i FROM t)),
            hit AS (SELECT DISTINCT pair_id, field, n, unnest(range(i, i + 5)) AS word FROM runs r WHERE NOT train AND EXISTS (SELECT 1 FROM runs q WHERE q.train AND q.field = r.field AND q.g = r.g))
            SELECT pair_id, field, n AS words, round(count(*) / n, 6) AS covered FROM hit GROUP BY pair_id, field, n""",
        "p7_items": f"""WITH {leaks}, spots AS (SELECT doc_id, len(ws) AS n, i, array_to_string(list_slice(ws, i, i + 11), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM d)),
            covered AS (SELECT doc_id, count(DISTINCT word) / any_value(n) AS share FROM (SELECT doc_id, n, unnest(range(i, i + 12)) AS word FROM spots WHERE g IN (SELECT g FROM ({running.format('item_id', 11, 'e')}))) GROUP BY 1)
            SELECT item_id, suite, count(f.doc_id) AS documents, round(max(share), 4) AS most_covered FROM eval_items LEFT JOIN found f USING (item_id) LEFT JOIN covered c ON f.doc_id = c.doc_id GROUP BY ALL""",
        "p7_found": f"WITH {leaks} SELECT * FROM found",
    }
