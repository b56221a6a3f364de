"""The thin queries over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import chaining, chat, decontaminate, divergence, html_extract, line_dedup, merkle, mixing, pii, quality, simhash, token_counts, warc
from tidewell.llm.common import scratch, table


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged, _ = quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op4_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.repeated_passages(table(spark, sf_dir, "documents"))


#: What both rows of conversation -7 say.
PROBE = "</s>[INST] ok [/INST]"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return chat.chat_report(rows.unionByName(probe))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proof_report(table(spark, sf_dir, "documents"))


# Companions: the columns of these operators' results that SQL can express, over the same whole tables ---------------------


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op1: each document's size, and its source's size and target."""
    return op1_pareto_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op2: the base counts and the base rule."""
    return op2_quality_rules(spark, sf_dir).drop("kept")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op3: the base kinds."""
    return op3_pii_spans(spark, sf_dir).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_quality_rules": op2_quality_rules,
    "op3_pii_spans": op3_pii_spans,
    "op4_tag_path_text": op4_tag_path_text,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_simhash_vptree": op7_simhash_vptree,
    "op8_warc_shards": op8_warc_shards,
    "op9_decontamination": op9_decontamination,
    "op10_collinear_chains": op10_collinear_chains,
    "op11_chat_format": op11_chat_format,
    "op12_source_divergence": op12_source_divergence,
    "op13_merkle_manifest": op13_merkle_manifest,
    "mix_targets": mix_targets,
    "quality_base": quality_base,
    "pii_base": pii_base,
}

WORDS_SQL = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _items_sql(table: str, key: str) -> str:
    """Key and normalised words of a table's texts."""
    return rf"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}"


def _spans_sql(kind: str, rank: int, pattern: str, valid: str) -> str:
    """Rows (doc_id, k, kind, rank, start, stop) of a kind's matches m that are valid: places from the gaps g between matches."""
    start = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    return f"""SELECT k, '{kind}' AS kind, {rank} AS rank, CAST({start} AS BIGINT) AS start, CAST({start} + length(m[i]) AS BIGINT) AS stop
      FROM (SELECT k, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT k, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d)) WHERE {valid.replace('?', 'm[i]')}"""


DIGITS_SQL = "regexp_replace(?, '[^0-9]', '', 'g')"
LUHN_SQL = f"list_sum(list_transform(range(1, length({DIGITS_SQL}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST(reverse({DIGITS_SQL})[j] AS INTEGER) ELSE (2 * CAST(reverse({DIGITS_SQL})[j] AS INTEGER)) // 10 + (2 * CAST(reverse({DIGITS_SQL})[j] AS INTEGER)) % 10 END)) % 10 = 0"
SPANS_SQL = " UNION ALL ".join(
    [
        _spans_sql("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        _spans_sql("ip", 1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(?, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || ltrim(x, '0') AS BIGINT) > 255)) = 0"),
        _spans_sql("card", 2, r"[0-9](?:[\x20-]?[0-9])+", f"length({DIGITS_SQL}) BETWEEN 14 AND 19 AND {LUHN_SQL}"),
        _spans_sql("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS_SQL}) BETWEEN 10 AND 15"),
    ]
)



def _chats_sql(template: chat.Template) -> str:
    """Digests of the rows themselves, and the length that the template gives them."""
    heads = sorted({c[0] for c in template.controls})
    places = "|".join(rf"({chat.quoted(h)})(\\*(?:{'|'.join(chat.quoted(c[1:]) for c in template.controls if c[0] == h)}))" for h in heads)
    put = "".join(rf"\{2 * i + 1}" for i in range(len(heads))) + r"\\" + "".join(rf"\{2 * i + 2}" for i in range(len(heads)))
    length = lambda c: f"length(regexp_replace({c}, '{places}', '{put}', 'g'))"
    block = len(template.turn) + len(template.text) + len(template.close)
    return f"""
        WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
        o AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w IS DISTINCT FROM role AS opens FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY i)) AS turns_sha256,
          CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
          CAST(sum({length("t")} + CASE WHEN opens THEN {block} + {length("role")} ELSE {len(template.more)} END) + {len(template.begin) + len(template.finish)} AS BIGINT) AS formatted_chars
        FROM o GROUP BY conv_id
    """


def _manifest_sql(levels: int = 8, top_levels: int = 4) -> str:
    """The trees level by level, and proofs from the siblings before and after a node in its run: up to 16**levels rows of a source."""
    text = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda t: "sha256(" + " || ".join(text(t if c == "text" else c) for c in merkle.FIELDS) + ")"
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda b: [ascii(b), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(4294967295, list_reduce([4294967295] || {bits}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    parts = [
        f"""d AS (SELECT doc_id, source, {leaf("text")} AS leaf, {leaf(f"(CASE WHEN {crc} % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END)")} AS seen FROM documents)""",
        "o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
        "n0 AS (SELECT source, i, leaf AS h, count(*) OVER (PARTITION BY source) AS m FROM o)",
    ]

    def grown(name: str, count: int) -> None:
        around = "coalesce(string_agg(h, '') OVER (PARTITION BY source, i // 16 ORDER BY i ROWS BETWEEN {}), '')"
        for j in range(count):
            parts.append(f"{name}{j + 1} AS (SELECT *, count(*) OVER (PARTITION BY source) AS m FROM (SELECT source, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{j} WHERE m > 1 GROUP BY source, i // 16))")
            parts.append(f"{name}s{j} AS (SELECT source, i, {around.format('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {around.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {name}{j} WHERE m > 1)")
        parts.append(f"{name}r AS ({' UNION ALL '.join(f'SELECT source, h FROM {name}{j} WHERE m = 1' for j in range(count + 1))})")

    grown("n", levels)
    parts.append("t AS (SELECT source AS s, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM nr)")
    parts.append("t0 AS (SELECT 0 AS source, i, h, count(*) OVER () AS m FROM t)")
    grown("t", top_levels)
    parts.append("f0 AS (SELECT o.doc_id, o.source, o.i, o.leaf, t.i AS ti, t.h AS subroot, '' AS proof, o.seen AS h FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.s)")
    for j in range(levels + top_levels):
        level = f"ns{j} s ON f.source IS NOT DISTINCT FROM s.source AND s.i = f.i // {16**j}" if j < levels else f"ts{j - levels} s ON s.i = f.ti // {16 ** (j - levels)}"
        parts.append(f"f{j + 1} AS (SELECT doc_id, f.source, f.i, leaf, ti, subroot, proof || coalesce(l || r, '') AS proof, CASE WHEN l IS NULL THEN h ELSE sha256(l || h || r) END AS h FROM f{j} f LEFT JOIN {level})")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, tr.h AS root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = tr.h AS verified FROM f{levels + top_levels} f, tr"


ORACLE_SQL: dict[str, str] = {
    # a source is capped where its cap a weight is least; the first k in that order are capped where the next is not
    "mix_targets": f"""
        WITH d AS (SELECT doc_id, source, CAST(len({WORDS_SQL}) AS BIGINT) AS size FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)),
        s AS (SELECT source, sum(size) AS n, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
        o AS (SELECT *, row_number() OVER (ORDER BY n / w, source NULLS LAST) AS i FROM s),
        c AS (SELECT *, coalesce(sum(2 * n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
            sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(n) OVER () AS whole FROM o),
        l AS (SELECT min_by((1.5 * whole - capped) / rest, i) AS share FROM c WHERE 2 * n * rest >= (1.5 * whole - capped) * w)
        SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, round(least(2.0 * n, w * share), 3) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, l
    """,
    "quality_base": f"""
        WITH d AS (SELECT doc_id, t, row_number() OVER () AS k, {WORDS_SQL} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
        g AS (SELECT k, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'i': i, 'g': w[i:i + 2]}})) AS x FROM d),
        r AS (SELECT k, x.i AS i, count(*) OVER (PARTITION BY k, x.g) AS seen FROM g),
        n AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM r WHERE seen > 1) GROUP BY k),
        b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
            CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
            FROM d LEFT JOIN n ON d.k = n.k)
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
    """,
    "pii_base": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS k FROM documents), s AS ({SPANS_SQL}),
        n AS (SELECT k, count(*) FILTER (rank = 0) AS e, count(*) FILTER (rank = 1) AS i, count(*) FILTER (rank = 2) AS c, count(*) FILTER (rank = 3) AS p,
            string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM s GROUP BY k)
        SELECT doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN n ON d.k = n.k
    """,
    "op9_decontamination": f"""
        WITH b AS ({_items_sql("benchmark", "CAST(item_id AS VARCHAR) AS item")}),
        win AS (SELECT item, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
        d AS ({_items_sql("documents", "doc_id, row_number() OVER () AS k")}),
        p AS (SELECT k, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'i': i, 'g': array_to_string(w[i:i + n - 1], ' ')}})) AS x FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
        hit AS (SELECT DISTINCT k, x.i AS i, p.n, item FROM p JOIN win ON x.g = win.g AND p.n = win.n),
        pos AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS j FROM hit) GROUP BY k),
        its AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY k)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN pos ON d.k = pos.k LEFT JOIN its ON d.k = its.k
    """,
    "op8_warc_shards": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
        ), k AS (SELECT d, max(page_id) AS keep FROM p WHERE n >= 1000 GROUP BY d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN keep <> page_id THEN keep END AS refers_to
        FROM p LEFT JOIN k ON p.d = k.d AND p.n >= 1000
    """,
    "op11_chat_format": _chats_sql(chat.Template()),
    # every kept term of every group, so no correction is needed
    "op12_source_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
        w AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS docs FROM w GROUP BY lang, source, term),
        t AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 10),
        l AS (SELECT g.lang, coalesce(count(t.term), 0) AS v, coalesce(sum(t.n), 0) AS n FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN t ON t.lang = g.lang GROUP BY g.lang),
        s AS (SELECT g.lang, g.source, l.v, l.n AS ln, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g JOIN l ON l.lang = g.lang LEFT JOIN (c JOIN t ON c.lang = t.lang AND c.term = t.term) ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source, l.v, l.n),
        r AS (SELECT s.lang, s.source, t.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (s.n + 2 * s.v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (t.n + 2) // (s.ln + 2 * s.v) AS q
            FROM s JOIN t ON t.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = t.term),
        pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM r a JOIN r b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
        u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pv.value, 0) AS BIGINT) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source
            UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM r WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM u) WHERE part = 'pair' OR rank <= 10
    """,
    "op13_merkle_manifest": _manifest_sql(),
}
