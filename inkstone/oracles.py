"""DuckDB SQL for the engine's queries, where SQL can express them.

The SQL takes other ways than the DataFrame code where there are any: numbers are written
digit by digit and cleaned with patterns, sandhi looks at window neighbours, shortest paths
are recursive. Reference tables (syllables, the sample dictionary) stand in it as VALUES.
"""

from __future__ import annotations

from . import source_queries
from .functions.columns import syllable_rows
from .functions.glyphs import CANONICAL, HONG_KONG
from .functions.orthography import capital
from .functions.phonology import INVENTORY, parse, spelling
from .functions.romanise import wade_giles_spelling, word
from .operators.dictionary import numbers
from .plans import sample
from .queries import GLYPHS, SANDHI_TOKENS, WORDS


def _text(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def _values(rows, columns: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_text, r)) + ')' for r in rows)}) AS {columns}"


def _list(items) -> str:
    return "[" + ", ".join(map(_text, items)) + "]"


def _pick(items, index: str) -> str:
    n = len(items)
    return f"({_list(items)})[((({index}) % {n} + {n}) % {n}) + 1]"


def _cardinal(source: str, key: str, n: str, name: str = "hanzi", mode: str = "always") -> str:
    """key and the hanzi of n, a whole number below 10**12."""

    def group(k: int) -> str:
        t = f"translate(lpad(CAST(g{k} AS VARCHAR), 4, '0'), '0123456789', '零一二三四五六七八九')"
        mixed = " || ".join(f"substr({t}, {i + 1}, 1) || '{u}'" for i, u in enumerate(("千", "百", "十", "")))
        body = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({mixed}, '零[千百十]', '零', 'g'), '零+', '零', 'g'), '零$', ''), '^零', '')"
        top = " AND ".join([f"g{j} = 0" for j in range(k + 1, 3)] or ["true"])
        body = f"CASE WHEN {top} AND g{k} BETWEEN 10 AND 19 THEN substr({body}, 2) ELSE {body} END"
        if mode == "never":
            return body
        when = "true" if mode == "always" else f"({top})"
        lone = f"WHEN {when} AND g{k} = 2 THEN '两'" if k else ""
        return f"CASE {lone} WHEN {when} AND g{k} >= 2000 AND g{k} < 3000 THEN '两' || substr({body}, 2) ELSE {body} END"

    return f"""SELECT {key}, CASE WHEN n = 0 THEN '零' WHEN g2 = 0 THEN w1 ELSE b2 || '亿' || CASE WHEN w1 <> '' AND g1 < 1000 THEN '零' ELSE '' END || w1 END AS {name}
FROM (SELECT *, CASE WHEN g1 = 0 THEN b0 ELSE b1 || '万' || CASE WHEN b0 <> '' AND g0 < 1000 THEN '零' ELSE '' END || b0 END AS w1
FROM (SELECT *, {group(0)} AS b0, {group(1)} AS b1, {group(2)} AS b2
FROM (SELECT *, n % 10000 AS g0, (n // 10000) % 10000 AS g1, (n // 100000000) % 10000 AS g2 FROM (SELECT *, CAST({n} AS BIGINT) AS n FROM {source}))))"""


_TEXTS = "(SELECT o_orderkey, " + " || ".join(_pick(WORDS, f"o_orderkey // {d}") for d in (1, 7, 30)) + " AS text FROM orders)"
_RUNS = f"(SELECT DISTINCT text AS run_id, text FROM {_TEXTS})"


def _dictionary() -> str:
    """One row for each reading: key, rank, size of the key, reading, cost."""
    rows = []
    for e in sample.dictionary().entries.values():
        for rank, r in enumerate([e.reading, *(e.alternates if len(e.key) == 1 else ())]):
            rows.append((e.key, rank, len(e.key), " ".join(numbers(r)), len(r), e.cost + rank))
    return f"(SELECT key, rank, size, reading, syllables, CAST(cost AS DOUBLE) AS cost FROM {_values(rows, 'v(key, rank, size, reading, syllables, cost)')}) AS d"


_EDGES = f"""(SELECT run_id, "at" AS "start", "at" + size AS "end", reading, syllables, cost, size, CAST(row_number() OVER (PARTITION BY run_id ORDER BY "at", size = 1, size, rank) - 1 AS INT) AS ord
FROM (SELECT run_id, text, unnest(range(length(text))) AS "at" FROM {_RUNS}) r JOIN {_dictionary()} ON substr(r.text, CAST(r."at" + 1 AS INT), d.size) = d.key)"""
_UNITS = f"""(SELECT run_id, ord, "start" + k AS "start", "start" + k + 1 AS "end", string_split(reading, ' ')[k + 1] AS reading, "start" AS e_start, "end" AS e_end, cost FROM (SELECT *, unnest(range(size)) AS k FROM {_EDGES} WHERE syllables = size)
UNION ALL SELECT run_id, ord, "start", "end", reading, "start", "end", cost FROM {_EDGES} WHERE syllables <> size)"""


def _written(system: str, taiwan: bool) -> list[tuple]:
    """Each word of the sample dictionary in a system, with what sandhi asks of its neighbours: (word, written, written with a second tone where it is a lone third one, first spelling, first tone, last spelling, whether it is hyphened when said twice)."""
    out = []
    for e in sample.dictionary().entries.values():
        own = e.taiwan or e.reading if taiwan else e.reading
        # a place name's generic is a word of its own
        parts = [own[:2], own[2:]] if e.key == "北京市" else [own]
        said = " ".join(capital(word(system, r)) if e.proper else word(system, r) for r in parts)
        lone = word(system, (own[0].toned(2),)) if len(own) == 1 and own[0].tone == 3 else said
        out.append((e.key, said, lone, spelling(own[0]), own[0].tone, spelling(own[-1]), len(e.key) == 2 and not e.proper))
    return out


def _converted(words: str, system: str, name: str, joined: str = "", taiwan: bool = False) -> str:
    """Every order's text in a system, from (run_id, start, word); the text ends in a number, a measure word and a full stop."""
    one = lambda text: _text(word(system, (parse(text),)))
    powers = "('shi', 'bai', 'qian', 'wan')"
    counts = f"coalesce(b, '') <> 'di' AND (coalesce(b, '') NOT IN {powers} OR coalesce(f, '') IN ('shi', 'bai', 'qian', 'wan', 'ling'))"
    said = f"CASE WHEN word = '一' AND {counts} AND t = 4 THEN {one('yí')} WHEN word = '一' AND {counts} AND t < 4 THEN {one('yì')} WHEN word = '不' AND t = 4 THEN {one('bú')} {"WHEN t = 3 THEN lone" if taiwan else ""} ELSE written END"
    tail = f"{word(system, (parse('liǎng'),))} {word(system, (parse('gè'),))}."
    return f"""WITH {joined} w AS (SELECT run_id, "start", word, written, lone, lag(z) OVER o AS b, lead(a) OVER o AS f, lead(t) OVER o AS t, CASE WHEN twice AND lag(word) OVER o = word THEN '-' ELSE ' ' END AS joint FROM ({words}) JOIN {_values(_written(system, taiwan), 'v(key, written, lone, a, t, z, twice)')} ON key = word WINDOW o AS (PARTITION BY run_id ORDER BY "start")),
d AS (SELECT run_id, ltrim(string_agg(joint || {said}, '' ORDER BY "start")) AS said FROM w GROUP BY 1)
SELECT o_orderkey, text || '2个。' AS text, upper(substr(said, 1, 1)) || substr(said, 2) || ' {tail}' AS {name} FROM {_TEXTS} JOIN d ON run_id = text"""


_GREEDY = f"""best AS (SELECT run_id, "start", max(size) AS size FROM {_EDGES} GROUP BY 1, 2), walk AS (SELECT run_id, "start", size FROM best WHERE "start" = 0 UNION ALL SELECT b.run_id, b."start", b.size FROM walk w JOIN best b ON b.run_id = w.run_id AND b."start" = w."start" + w.size),"""
_CHEAPEST = f"""e AS MATERIALIZED (SELECT run_id, "start", "end", min(cost) AS cost FROM {_EDGES} GROUP BY 1, 2, 3),
walk(run_id, place, total, cuts) AS (SELECT DISTINCT run_id, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), [CAST(0 AS BIGINT)] FROM e UNION ALL SELECT w.run_id, e."end", w.total + e.cost, list_append(w.cuts, e."end") FROM walk w JOIN e ON e.run_id = w.run_id AND e."start" = w.place),
path AS (SELECT run_id, arg_min(cuts, total) AS cuts FROM walk WHERE place = length(run_id) GROUP BY 1),"""
_GREEDY_WORDS = """SELECT run_id, "start", substr(run_id, CAST("start" + 1 AS INT), CAST(size AS INT)) AS word FROM walk"""
_CHEAPEST_WORDS = """SELECT run_id, cuts[k] AS "start", substr(run_id, CAST(cuts[k] + 1 AS INT), CAST(cuts[k + 1] - cuts[k] AS INT)) AS word FROM (SELECT run_id, cuts, unnest(range(1, len(cuts))) AS k FROM path)"""
_SYLLABLES = f"(SELECT o_orderkey, {_pick(INVENTORY, 'o_orderkey')} AS spelling, CAST((o_orderkey // 424) % 5 + 1 AS INT) AS tone FROM orders)"


def _sounds(*names: str) -> str:
    columns = "spelling tone erhua initial final marks numbers superscript toneless bopomofo wade_giles yale gwoyeu ipa".split()
    at = [columns.index(c) for c in ("spelling", "tone", *names)]
    rows = [[r[k] for k in at] for r in syllable_rows() if not r[2] and r[1] is not None]
    return _values(rows, f"t(spelling, tone{''.join(', ' + n for n in names)})")


def _joined(*names: str) -> str:
    return f"{_SYLLABLES} s JOIN {_sounds(*names)} USING (spelling, tone)"


_glyph = " || ".join(f"substr('{GLYPHS}', CAST((o_orderkey // {d}) % {len(GLYPHS)} + 1 AS INT), 1)" for d in (1, 3, 10))
_canonical = f"translate({_glyph}, '{''.join(CANONICAL)}', '{''.join(CANONICAL.values())}')"
_clock = "CASE WHEN hour(ts) = 2 THEN '两' ELSE h.hanzi END || '点' || CASE WHEN minute(ts) = 0 THEN '' ELSE CASE WHEN minute(ts) < 10 THEN '零' ELSE '' END || m.hanzi || '分' END"
_small = _cardinal("(SELECT unnest(range(100)) AS k)", "k", "k")


def _digits(n: str) -> str:
    return f"translate(CAST({n} AS VARCHAR), '0123456789', '〇一二三四五六七八九')"


_SPOKEN = f"(SELECT l_orderkey, l_linenumber, {_pick(SANDHI_TOKENS, 'l_partkey')} AS t FROM lineitem)"
_NEIGHBOURS = f"(SELECT *, lag(t) OVER w AS b, lead(t) OVER w AS f, row_number() OVER w AS place FROM {_SPOKEN} WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, t))"
_POWERS = "('shi', 'bai', 'qian', 'wan')"
_NON_ASCII = r"regexp_replace(text, '[\x00-\x7F]', '', 'g')"


def oracle_sql() -> dict[str, str]:
    sql = {
        "numeral_cardinal": f"SELECT a.o_orderkey, a.hanzi, b.larger FROM ({_cardinal('orders', 'o_orderkey', 'o_orderkey')}) a JOIN ({_cardinal('orders', 'o_orderkey', 'o_orderkey * 1009', 'larger')}) b USING (o_orderkey)",
        "numeral_digits": f"SELECT o_orderkey, {_digits('o_orderkey')} AS hanzi FROM orders",
        "numeral_liang_modes": "SELECT p_partkey, always, in_front, never FROM " + " JOIN ".join(f"({_cardinal('part', 'p_partkey', 'p_partkey * 22 + 2', name, mode)}) {name}_{' USING (p_partkey)' if k else ''}" for k, (name, mode) in enumerate((("always", "always"), ("in_front", "leading"), ("never", "never")))),
        "numeral_percent": f"SELECT '百分之' || hanzi AS hanzi, count(*) AS n FROM lineitem JOIN ({_small}) ON k = CAST(round(abs(l_discount) * 100) AS INT) GROUP BY 1",
        "numeral_fraction": f"SELECT q.hanzi || '分之' || l.hanzi AS hanzi, count(*) AS n FROM lineitem JOIN ({_small}) l ON l.k = l_linenumber JOIN ({_small}) q ON q.k = CAST(l_quantity AS INT) GROUP BY 1",
        "numeral_decimal": f"SELECT p_partkey, hanzi || '点' || translate(split_part(CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR), '.', 2), '0123456789', '零一二三四五六七八九') AS hanzi FROM part JOIN ({_cardinal('part', 'p_partkey', 'floor(CAST(p_retailprice AS DECIMAL(12,2)))')}) USING (p_partkey)",
        "numeral_pinyin": f"SELECT syllable, count(*) AS n FROM (SELECT unnest(string_split(hanzi, '')) AS c FROM lineitem JOIN ({_small}) ON k = CAST(l_quantity AS INT)) JOIN {_values([(c, numbers(sample.read(r))[0]) for c, r in zip('零一二两三四五六七八九十', 'líng yī èr liǎng sān sì wǔ liù qī bā jiǔ shí'.split(), strict=True)], 'r(c, syllable)')} USING (c) GROUP BY 1",
        "clock_reading": f"SELECT {_clock} AS hanzi, count(*) AS n FROM events JOIN ({_small}) h ON h.k = hour(ts) JOIN ({_small}) m ON m.k = minute(ts) GROUP BY 1",
        "year_reading": f"SELECT {_digits('year(o_orderdate)')} || '年' AS hanzi, count(*) AS n FROM orders GROUP BY 1",
        "tone_write": f"SELECT o_orderkey, marks, numbers, superscript FROM {_joined('marks', 'numbers', 'superscript')}",
        "tone_strip": f"SELECT o_orderkey, toneless, CASE WHEN marks <> toneless THEN tone END AS tone FROM {_joined('marks', 'toneless')}",
        "syllable_parse": f"SELECT o_orderkey, initial, final, tone FROM {_joined('initial', 'final')}",
        "separable_start": f"SELECT substr(spelling, 1, 1) IN ('a', 'o', 'e') AS separable, count(*) AS n FROM {_SYLLABLES} GROUP BY 1",
        "transcription_ambiguity": f"SELECT CAST(candidates AS INT) AS candidates, count(*) AS n FROM {_SYLLABLES} s JOIN (SELECT spelling, count(*) OVER (PARTITION BY wade) AS candidates FROM {_values([(x, wade_giles_spelling(parse(x))) for x in INVENTORY], 'w(spelling, wade)')}) USING (spelling) GROUP BY 1",
        "yi_bu_sandhi": f"""SELECT l_orderkey, string_agg(CASE WHEN t = 'yi1' AND coalesce(regexp_replace(b, '[0-5]$', ''), '') <> 'di' AND (coalesce(regexp_replace(b, '[0-5]$', ''), '') NOT IN {_POWERS} OR coalesce(regexp_replace(f, '[0-5]$', ''), '') IN ('shi', 'bai', 'qian', 'wan', 'ling'))
THEN CASE WHEN f LIKE '%4' THEN 'yi2' WHEN f IS NULL OR f LIKE '%5' THEN 'yi1' ELSE 'yi4' END WHEN t = 'bu4' AND f LIKE '%4' THEN 'bu2' ELSE t END, ' ' ORDER BY place) AS said FROM {_NEIGHBOURS} GROUP BY 1""",
        "third_tone_flat": f"SELECT l_orderkey, string_agg(CASE WHEN t LIKE '%3' AND f LIKE '%3' THEN substr(t, 1, length(t) - 1) || '2' ELSE t END, ' ' ORDER BY place) AS said FROM {_NEIGHBOURS} GROUP BY 1",
        "apostrophe_always": f"SELECT o_orderkey, a || CASE WHEN substr(b, 1, 1) IN ('a', 'o', 'e') THEN '''' ELSE '' END || b AS word FROM (SELECT o_orderkey, {_pick(INVENTORY, 'o_orderkey')} AS a, {_pick(INVENTORY, 'o_orderkey * 5 + 1')} AS b FROM orders)",
        "latin_punctuation": "SELECT p_partkey, p_name || ', ' || p_brand || '. ' || p_type || '! 好?' AS written FROM part",
        "sentences": r"SELECT lang, regexp_matches(coalesce(text, ''), '[!?。！？]') OR regexp_matches(coalesce(text, ''), '(^|[^0-9])\.|\.([^0-9]|$)') AS sentence, count(*) AS n FROM documents GROUP BY 1, 2",
        "html_escape": "SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS digest FROM pages",
        "slug_ascii": "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part",
        "glyph_canonical": f"SELECT o_orderkey, {_canonical} AS canonical FROM orders",
        "glyph_hongkong": f"SELECT o_orderkey, translate({_canonical}, '{''.join(HONG_KONG)}', '{''.join(HONG_KONG.values())}') AS hong_kong FROM orders",
        "run_split": r'''SELECT p_partkey, CAST("at" - 1 AS INT) AS run_no, runs["at"] AS text, regexp_matches(runs["at"], '^\p{Han}') AS is_han FROM (SELECT p_partkey, runs, unnest(range(1, len(runs) + 1)) AS "at" FROM (SELECT p_partkey, regexp_extract_all(CAST(p_size AS VARCHAR) || '个' || p_name || '大小', '\p{Han}+|[^\p{Han}]+') AS runs FROM part))''',
        "detect_script": f"SELECT o_orderkey, CASE WHEN hans > hant THEN 'Hans' WHEN hant > hans THEN 'Hant' END AS script FROM (SELECT o_orderkey, length(regexp_replace(t, '[^银长儿]', '', 'g')) AS hans, length(regexp_replace(t, '[^銀長兒]', '', 'g')) AS hant FROM (SELECT o_orderkey, text || CASE WHEN o_orderkey % 3 = 0 THEN '銀銀' ELSE '' END AS t FROM {_TEXTS}))",
        "character_histogram": f"SELECT character, count(*) AS n FROM (SELECT unnest(string_split({_NON_ASCII}, '')) AS character FROM documents) WHERE character <> '' GROUP BY 1",
        "script_only_characters": f"""WITH e AS (SELECT {_pick([*WORDS, "abc"], "p_partkey")} AS hans, CASE WHEN p_partkey % 2 = 0 THEN {_pick([*WORDS, "abc"], "p_partkey")} ELSE {_pick(["銀長", "兒海", "abd"], "p_partkey // 62")} END AS hant FROM part),
d AS (SELECT translate(hans, '{''.join(CANONICAL)}', '{''.join(CANONICAL.values())}') AS hans, translate(hant, '{''.join(CANONICAL)}', '{''.join(CANONICAL.values())}') AS hant FROM e WHERE hans <> hant),
a AS (SELECT DISTINCT unnest(string_split(hans, '')) AS character FROM d), b AS (SELECT DISTINCT unnest(string_split(hant, '')) AS character FROM d)
SELECT 'h' AS script, character FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'H', character FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
        "lattice_edges": f'SELECT run_id, CAST("start" AS INT) AS "start", CAST("end" AS INT) AS "end", ord, reading, round(cost, 4) AS cost FROM {_EDGES}',
        # of the rules, only the one on the r suffix finds its words in the sample dictionary
        "edge_rules": f"""SELECT run_id, CAST("start" AS INT) AS "start", CAST("end" AS INT) AS "end", reading FROM {_EDGES} WHERE NOT (size = 1 AND substr(run_id, CAST("start" AS INT), 2) = '玩儿' AND "start" > 0)""",
        "cut_points": f'SELECT run_id, CAST("at" AS INT) AS "at" FROM (SELECT run_id, unnest(range(length(text) + 1)) AS "at" FROM {_RUNS}) p WHERE NOT EXISTS (SELECT 1 FROM {_EDGES} e WHERE e.run_id = p.run_id AND e."start" < p."at" AND p."at" < e."end")',
        "reading_locks": f"""SELECT run_id, CAST("at" AS INT) AS "at", claims, claims = 1 AND (SELECT bool_and(o.claims = 1) FROM c o WHERE o.run_id = c.run_id AND o."at" >= c.s AND o."at" < c.e) AS locked
FROM c""",
        "greedy_match": f"""WITH RECURSIVE best AS (SELECT run_id, "start", max(size) AS size FROM {_EDGES} GROUP BY 1, 2), walk AS (SELECT run_id, "start", size FROM best WHERE "start" = 0 UNION ALL SELECT b.run_id, b."start", b.size FROM walk w JOIN best b ON b.run_id = w.run_id AND b."start" = w."start" + w.size)
SELECT run_id, CAST("start" AS INT) AS "start", substr(run_id, CAST("start" + 1 AS INT), CAST(size AS INT)) AS word FROM walk""",
        "shortest_path": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT run_id, "start", "end", min(cost) AS cost FROM {_EDGES} GROUP BY 1, 2, 3), walk(run_id, place, total) AS (SELECT DISTINCT run_id, CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM e UNION ALL SELECT w.run_id, e."end", w.total + e.cost FROM walk w JOIN e ON e.run_id = w.run_id AND e."start" = w.place)
SELECT run_id, round(min(total), 4) AS total FROM walk WHERE place = length(run_id) GROUP BY 1""",
        "confidence_claims": f"""WITH RECURSIVE x AS MATERIALIZED (SELECT run_id, "start", "end", min(cost + 16) AS cost FROM {_EDGES} GROUP BY 1, 2, 3),
ahead(run_id, place, total) AS (SELECT DISTINCT run_id, CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM x UNION ALL SELECT w.run_id, x."end", w.total + x.cost FROM ahead w JOIN x ON x.run_id = w.run_id AND x."start" = w.place),
back(run_id, place, total) AS (SELECT DISTINCT run_id, length(run_id), CAST(0 AS DOUBLE) FROM x UNION ALL SELECT w.run_id, x."start", w.total + x.cost FROM back w JOIN x ON x.run_id = w.run_id AND x."end" = w.place),
a AS MATERIALIZED (SELECT run_id, place, min(total) AS total FROM ahead GROUP BY 1, 2), b AS MATERIALIZED (SELECT run_id, place, min(total) AS total FROM back GROUP BY 1, 2)
SELECT u.run_id, CAST(u."start" AS INT) AS "start", CAST(u."end" AS INT) AS "end", u.reading, round(min(a.total + u.cost + 16 + b.total), 4) AS cost FROM {_UNITS} u JOIN a ON a.run_id = u.run_id AND a.place = u.e_start JOIN b ON b.run_id = u.run_id AND b.place = u.e_end GROUP BY 1, 2, 3, 4""",
        "claim_keys": """SELECT key, frequency FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY alias, frequency DESC, hans) AS r FROM (
SELECT split_part(p_name, ' ', -1) AS key, 0 AS alias, p_partkey AS frequency, split_part(p_name, ' ', -1) AS hans FROM part UNION ALL SELECT upper(split_part(p_name, ' ', 1)), 1, p_partkey, split_part(p_name, ' ', -1) FROM part)) WHERE r = 1""",
        "tier_standard": "SELECT split_part(p_name, ' ', -1) AS hans, p_partkey AS frequency FROM part WHERE length(split_part(p_name, ' ', -1)) > 1 ORDER BY frequency DESC, hans LIMIT 100",
        "frequency_buckets": "SELECT c_custkey, bucket, round(CAST(15 - bucket AS DOUBLE) + CAST(4.62 AS DOUBLE), 2) AS cost FROM (SELECT c_custkey, CAST(least(15, floor(ln(1 + greatest(floor(c_acctbal), 0)) * (15 / ln(1 + (SELECT max(floor(c_acctbal)) FROM customer))) + 0.5)) AS INT) AS bucket FROM customer)",
        "argmax_tally": "SELECT p_brand AS brand, CASE WHEN grouping(l_linestatus) = 1 THEN '*' ELSE l_linestatus END AS key, l_returnflag AS flag, count(*) AS count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY GROUPING SETS ((p_brand, l_returnflag, l_linestatus), (p_brand, l_returnflag))",
        "name_boundaries": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN coalesce(array_to_string(list_filter(range(1, len(string_split(p_name, ' '))), lambda k: (p_partkey + k) % 3 = 0), '.'), '') ELSE '' END AS boundaries FROM part",
        "dictionary_lookup": f"SELECT word, count(*) AS n, any_value(d.reading) AS reading FROM (SELECT substr(text, 1, 2) AS word FROM {_TEXTS}) LEFT JOIN (SELECT * FROM {_dictionary()} WHERE rank = 0) AS d ON d.key = word GROUP BY 1",
    }
    for system in ("bopomofo", "wade_giles", "yale", "gwoyeu", "ipa"):
        sql[f"to_{system}"] = f"SELECT {system} AS written, count(*) AS n FROM {_joined(system)} GROUP BY 1"
    claims = f"""SELECT run_id, "at", count(DISTINCT ("start", "end", reading)) AS claims, min("start") AS s, max("end") AS e FROM (SELECT *, unnest(range("start", "end")) AS "at" FROM {_UNITS}) GROUP BY 1, 2"""
    sql |= source_queries.oracle_sql()
    sql["convert_greedy"] = _converted(_GREEDY_WORDS, "pinyin", "pinyin", f"RECURSIVE {_GREEDY}")
    sql["convert_taiwan"] = _converted(_CHEAPEST_WORDS, "pinyin", "pinyin", f"RECURSIVE {_CHEAPEST}", taiwan=True)
    other = [(r["hans"], r["hant"]) for r in sample.rows() if r["hans"] != r["hant"]] + [("银", "銀")]  # what all words agree on goes for the character alone
    sql["script_to_hant"] = f"""WITH RECURSIVE {_CHEAPEST} d AS (SELECT run_id, string_agg(coalesce(hant, word), '' ORDER BY "start") AS hant FROM ({_CHEAPEST_WORDS}) LEFT JOIN {_values(other, 'v(key, hant)')} ON key = word GROUP BY 1)
SELECT o_orderkey, text || '2个。' AS text, hant || '2个。' AS hant FROM {_TEXTS} JOIN d ON run_id = text"""
    # neutral syllables have no mark, so they are read without a tone; the suffix may be meant as well
    read = _values([(r[0], r[1], r[0] if r[1] == 5 else r[6], r[11], r[2], k) for k, r in enumerate(syllable_rows()) if r[1] is not None and not (r[1] == 5 and r[2])], "r(spelling, tone, read, yale, suffixed, place)")
    sql["read_candidates"] = f"""WITH r AS (SELECT * FROM {read}) SELECT yale, string_agg(read, ' ' ORDER BY suffixed, place) AS candidates FROM r WHERE yale IN (SELECT yale FROM {_SYLLABLES} s JOIN r USING (spelling, tone) WHERE NOT suffixed) GROUP BY 1"""
    own = _values([(r["hans"], r["hant"], " ".join(numbers(sample.read(r["cn"]))), " ".join(numbers(sample.read(r["tw"]))) if r["tw"] else "", r["frequency"], r["pos"], "p" if r["proper"] else "", ",".join(" ".join(numbers(sample.read(x))) for x in r["alternates"])) for r in sample.rows()], "r(hans, hant, reading, tw, frequency, pos, flags, others)")
    sql["stored_dictionary"] = f"""WITH r AS (SELECT * FROM {own}), k AS (SELECT hans AS key, 0 AS alias, * FROM r UNION ALL SELECT hant, 1, * FROM r WHERE hans <> hant),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY alias, frequency DESC, hans) AS n FROM k) WHERE n = 1),
d AS (SELECT key, string_agg(o.reading, ' ' ORDER BY place) AS derived, count(o.reading) = max(length(p.key)) AS whole FROM (SELECT key, place, substr(key, CAST(place AS INT), 1) AS one FROM (SELECT key, unnest(range(1, length(key) + 1)) AS place FROM c WHERE length(key) > 1)) p LEFT JOIN (SELECT key AS one, reading FROM c WHERE length(key) = 1) o USING (one) GROUP BY 1)
SELECT c.key, rtrim(concat_ws(chr(9), CASE WHEN whole AND derived = reading THEN '' ELSE reading END, tw, pos, flags, others), chr(9)) AS line, CAST(least(15, floor(ln(1 + frequency) * (15 / ln(1 + (SELECT max(frequency) FROM c))) + 0.5)) AS INT) AS bucket FROM c LEFT JOIN d ON d.key = c.key"""
    for name, system, column in (("convert", "pinyin", "pinyin"), ("convert_wade_giles", "wade_giles", "wade_giles"), ("convert_bopomofo", "bopomofo", "bopomofo")):
        sql[name] = _converted(_CHEAPEST_WORDS, system, column, f"RECURSIVE {_CHEAPEST}")
    sql["reading_locks"] = f"WITH c AS MATERIALIZED ({claims}) " + sql["reading_locks"]
    return sql
