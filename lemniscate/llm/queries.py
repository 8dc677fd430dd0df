"""The numbered queries: each applies one operator, with its production parameters, to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, divergence, imatch, language, line_dedup, merkle, ngram_join, pieces, ppm, simhash, substring_dedup, toxicity, url_filter
from .common import fold
from .url_filter import Rule

#: The rules of the url query: action, host, path.
RULES = (Rule("allow", "com"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table; one whose files give fewer partitions than there are cores is small, and is dealt out to all cores."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name == "documents" and rows.rdd.getNumPartitions() < cores else rows


def sha256(c) -> "F.Column":
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), RULES)


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.with_edits(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return toxicity.scored(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scores(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", sha256(F.col("text")).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), sha256(F.array_join("items", ",")).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(fold("doc_id", 4) != 2))
    found = language.identified(docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "languages")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.without_repeated_windows(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", sha256(F.col("kept")).alias("kept_sha256"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = F.when(tampered, merkle.leaf(n_chars=F.col("n_chars") + 1)).otherwise(merkle.leaf())
    rows = merkle.manifest(table(spark, sf_dir, "documents"), changed=changed)
    found = rows.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings("proof")).alias("proof_sha256"), merkle.folded("changed", "proof").alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_url_filter, op2_imatch, op3_toxicity, op4_ppm, op5_line_dedup, op6_decontaminate, op7_language, op8_pieces, op9_simhash, op10_substring_dedup, op11_divergence, op12_ngram_join, op13_merkle)}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def url_sql() -> str:
    from .url_filter import SOFT, STRICT

    strict, soft = sorted(set(STRICT)), {k: SOFT[k] for k in sorted(SOFT) if k not in STRICT}

    def hit(term: str) -> str:
        return f"regexp_matches(low, {quoted(f'(^|[^a-z0-9]){term}([^a-z0-9]|$)')})"

    def longest(value) -> str:
        order = sorted(RULES, key=lambda r: (-len(r.text), r.text))
        return "CASE " + " ".join(f"WHEN (host = {quoted(r.host)} OR suffix(host, {quoted('.' + r.host)})) AND starts_with(path, {quoted(r.path)}) THEN {quoted(value(r))}" for r in order) + " END"

    low = f"translate(coalesce(url, ''), '{common.UPPER}', '{common.LOWER}')"
    return f"""
        WITH p AS (SELECT page_id, coalesce(url, '') AS url, {low} AS low FROM pages),
        q AS (SELECT page_id, low, regexp_extract(low, '(?s)^.*?://([^/?#]*)', 1) AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
              {" + ".join(f"{hit(t)}::INT" for t in strict)} AS n_strict, {" + ".join(f"{hit(t)}::INT" for t in soft)} AS n_soft,
              {" + ".join(f"CASE WHEN {hit(t)} THEN {w!r}::DOUBLE ELSE 0 END" for t, w in soft.items())} AS soft_weight FROM p)
        SELECT page_id, host, path, {longest(lambda r: r.text)} AS rule,
               coalesce({longest(lambda r: r.action)}, CASE WHEN n_strict > 0 OR (n_soft > 1 AND soft_weight >= 2) THEN 'block' ELSE 'allow' END) AS verdict,
               n_strict, n_soft, soft_weight FROM q"""


LINES_SQL = f"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
    k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{common.UPPER}', '{common.LOWER}') AS key FROM l),
    o AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    m AS (SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND k.doc_id <> o.keeper AS gone FROM k LEFT JOIN o USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id"""

LEAKS_SQL = f"""
    WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
    bs AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS a FROM bw WHERE len(w) > 0),
    win AS (SELECT DISTINCT item_id, w[a:a + 9] AS win FROM bs),
    sizes AS (SELECT DISTINCT len(win) AS n FROM win),
    ds AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS a FROM dw, sizes WHERE len(w) >= n),
    hit AS (SELECT doc_id, a, n, item_id FROM (SELECT doc_id, a, n, w[a:a + n - 1] AS win FROM ds) JOIN win USING (win)),
    words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + n)) AS p FROM hit) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

WINDOWS_SQL = """
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, a, md5(array_to_string(w[a:a + 49], ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS a FROM d WHERE len(w) >= 50)),
    f AS (SELECT win, min(doc_id) AS first FROM s GROUP BY win),
    g AS (SELECT DISTINCT doc_id, unnest(range(a, a + 50)) AS p FROM s JOIN f USING (win) WHERE first < doc_id),
    r AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id),
    words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
    k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)"""


DIVERGENCE_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
    kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
    g AS (SELECT DISTINCT lang, source FROM d),
    v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
    c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
    a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    p AS (SELECT a.lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY a.lang, source) + 5 * v) AS p FROM a JOIN v USING (lang)),
    l AS (SELECT lang, term, sum(n) AS n FROM a GROUP BY lang, term),
    q AS (SELECT l.lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY l.lang) + 5 * v) AS q FROM l JOIN v USING (lang)),
    f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source),
    pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
              LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source),
    terms AS (SELECT p.lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50"""


JOIN_SQL = f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)] END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
    reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT links.a, reach.r FROM reach JOIN links ON links.b = reach.doc_id)
    SELECT w.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r) AS component_id FROM w JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY w.doc_id"""


def merkle_sql() -> str:
    def leaf(n_chars: str) -> str:
        texts = ("doc_id::VARCHAR", "source", "lang", n_chars, "text")
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}))::VARCHAR || ':' || {c}, '-')" for c in texts) + ")"

    plain, more = leaf("n_chars::VARCHAR"), leaf("(n_chars + 1)::VARCHAR")
    ups = """
        UNION ALL
        SELECT {g}, k + 1, p // 2, ceil(n / 2)::BIGINT, sha256(h || coalesce(nh, '')) FROM (
            SELECT {g}, k, p, n, h, lead(h) OVER (PARTITION BY {g} ORDER BY p) AS nh FROM {t} WHERE n > 1) WHERE p % 2 = 0"""
    return f"""
        WITH RECURSIVE crc AS (SELECT i, list_reduce(list_concat([i::UBIGINT], [x::UBIGINT for x in range(8)]), lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) AS v FROM range(256) r(i)),
        tab AS (SELECT list(v ORDER BY i) AS crcs FROM crc),
        d AS (SELECT doc_id, lang, {plain} AS leaf, CASE WHEN xor(list_reduce(list_concat([4294967295::UBIGINT], [ascii(x)::UBIGINT for x in string_split(doc_id::VARCHAR, '')]), lambda c, b: xor(c // 256, crcs[(xor(c, b) % 256 + 1)::BIGINT])), 4294967295::UBIGINT) % 7 = 0 THEN {more} ELSE {plain} END AS changed FROM documents, tab),
        o AS (SELECT doc_id, lang, leaf, changed, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM d),
        t AS (SELECT g, 0 AS k, pos AS p, n, leaf AS h FROM o {ups.format(g="g", t="t")}),
        s AS (SELECT g, h, k FROM t WHERE n = 1),
        u AS (SELECT 0 AS z, 0 AS k, g AS p, (SELECT count(*) FROM s) AS n, h FROM s {ups.format(g="z", t="u")}),
        r AS (SELECT h AS root FROM u WHERE n = 1),
        path AS (SELECT o.doc_id, o.lang, o.pos, t.k AS step, (o.pos >> t.k) % 2 AS side, t.h AS sib FROM o JOIN (SELECT DISTINCT g, k FROM t WHERE n > 1) lv USING (g) LEFT JOIN t ON t.g = o.g AND t.k = lv.k AND t.p = xor(o.pos >> lv.k, 1)
                 WHERE t.k IS NOT NULL
                 UNION ALL SELECT o.doc_id, o.lang, o.pos, 1000 + u.k, (o.g >> u.k) % 2, u.h FROM o JOIN (SELECT DISTINCT k FROM u WHERE n > 1) lv ON true JOIN u ON u.k = lv.k AND u.p = xor(o.g >> lv.k, 1)),
        steps AS (SELECT o.doc_id, o.lang, o.pos, lv.step, coalesce(path.side, 0) AS side, coalesce(path.sib, '') AS sib
                  FROM o JOIN (SELECT DISTINCT g, k AS step FROM t WHERE n > 1 UNION SELECT DISTINCT o.g, 1000 + u.k FROM o, u WHERE u.n > 1) lv USING (g)
                  LEFT JOIN path ON path.lang IS NOT DISTINCT FROM o.lang AND path.pos = o.pos AND path.step = lv.step),
        proof AS (SELECT lang, pos, string_agg(sib, '' ORDER BY step) AS proof, list(struct_pack(side := side, sib := sib) ORDER BY step) AS steps FROM steps GROUP BY lang, pos),
        fold AS (SELECT lang, pos, 0 AS i, changed AS h FROM o
                 UNION ALL SELECT fold.lang, fold.pos, i + 1, CASE WHEN steps[i + 1].side = 1 THEN sha256(steps[i + 1].sib || h) ELSE sha256(h || steps[i + 1].sib) END
                 FROM fold JOIN proof ON proof.lang IS NOT DISTINCT FROM fold.lang AND proof.pos = fold.pos WHERE i < len(steps))
        SELECT o.doc_id, o.leaf, s.h AS subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, fold.h AS folded_root, fold.h = root AS verified
        FROM o JOIN s USING (g) CROSS JOIN r LEFT JOIN proof ON proof.lang IS NOT DISTINCT FROM o.lang AND proof.pos = o.pos
        JOIN fold ON fold.lang IS NOT DISTINCT FROM o.lang AND fold.pos = o.pos AND fold.i = coalesce(len(steps), 0)"""


def oracle_sql() -> dict[str, str]:
    return {"op11_divergence": DIVERGENCE_SQL, "op12_ngram_join": JOIN_SQL, "op13_merkle": merkle_sql(), "op1_url_filter": url_sql(), "op5_line_dedup": LINES_SQL, "op6_decontaminate": LEAKS_SQL, "op10_substring_dedup": WINDOWS_SQL}
