"""The registered queries of this subpackage and their SQL forms (DuckDB)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, codes, exact_dedup, extraction, infill, licenses, mixing, packing, simhash, tokenfiles, topk, toxicity, urls
from .shared import cut_lineage, new_shared_path, spread_join, table

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def scaled(embedding: str):
    """Components as floor(256 x); those that are not finite become null."""
    return F.transform(embedding, lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.floor(x.cast("double") * 256)).cast("long"))


def op1_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), scaled("embedding").alias("vec"))
    found = topk.top_k(vectors, F.col("id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def byte_bpe() -> str:
    """Path of the byte-level BPE vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op2_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), byte_bpe())


def op3_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op5_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("epochs", "last_words", "source")


def op6_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], rows.schema)
    made = chat.format_branches(cut_lineage(chat.linear_nodes(rows.unionByName(extra))), best=None)
    turns, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.withColumns({"turns": turns, "loss": loss}).select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(written, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup_classes(table(spark, sf_dir, "documents")).drop("key")


def op8_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark, sf_dir):
    return extraction.extract_main_text(table(spark, sf_dir, "pages"))


def op10_url_filter(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), F.when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good")
    )
    return urls.judge_urls(table(spark, sf_dir, "pages"), labels, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_infill(spark, sf_dir):
    made = infill.restored(infill.infill_documents(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def word_bpe() -> str:
    """Path of the word-level BPE vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op12_tokens(spark, sf_dir):
    path = new_shared_path(spark, "tokens")
    tokenfiles.write_tokens(table(spark, sf_dir, "documents"), path, word_bpe())
    return tokenfiles.read_tokens(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op13_codes(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), scaled("embedding").alias("vec"), F.struct("label").alias("label"))
    coded, books = codes.compress(vectors)
    coded = cut_lineage(coded.drop("vec"))
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    joined = spread_join(coded, totals, ["label"])
    return joined.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books and books.sha256()).cast("string").alias("codebooks_sha256"))


QUERIES = {
    "op1_topk": op1_topk,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_mixing": op5_mixing,
    "op6_chat_format": op6_chat_format,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_html_extraction": op9_html_extraction,
    "op10_url_filter": op10_url_filter,
    "op11_infill": op11_infill,
    "op12_tokens": op12_tokens,
    "op13_codes": op13_codes,
}


def _escaped(col: str) -> str:
    for plain, written in chat.ESCAPES:
        col = f"replace({col}, '{plain}', '{written}')"
    return col


def _canonical(col: str) -> str:
    out = f"translate(coalesce({col}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"regexp_replace({out}, '{licenses.COPYRIGHT_LINE}', '\\1', 'g')"
    out = f"regexp_replace({out}, '{licenses.PUNCTUATION}', ' ', 'g')"
    for a, b in licenses.EQUIVALENT:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim({out}, ' ')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _unwrapped(col: str) -> str:
    """As ``_canonical``, but without whole lines that are a notice or a title."""
    lines = (p.removeprefix("(^|\\n)").replace("(?=\\n|$)", "") for p in (licenses.NOTICE_LINE, licenses.TITLE_LINE))
    alone = " OR ".join(f"regexp_full_match(x, '{line}')" for line in lines)
    low = f"translate(coalesce({col}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"array_to_string(list_transform(string_split({low}, chr(10)), lambda x: CASE WHEN {alone} THEN '' ELSE x END), chr(10))"
    out = f"regexp_replace({out}, '{licenses.PUNCTUATION}', ' ', 'g')"
    for x, y in licenses.EQUIVALENT:
        out = f"replace({out}, '{x}', '{y}')"
    return f"trim({out}, ' ')"


def _license_sql() -> str:
    known, both = (", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in rows) for rows in (licenses.KNOWN, [*licenses.KNOWN, *licenses.MORE]))
    whole = ", ".join(f"('{digest}', '{name}')" for digest, name in licenses.WHOLE.items())
    stem = lambda c: "(" + " OR ".join(f"contains(lower({c}), '{x}')" for x in licenses.STEMS) + ")"
    return f"""
WITH known AS (SELECT sha256({_canonical('text')}) AS digest, min(name) AS license_id FROM (VALUES {known}) AS k(name, text) GROUP BY 1),
wrapped AS (SELECT sha256({_unwrapped('text')}) AS digest, min(name) AS license_id FROM (VALUES {both}) AS k(name, text) WHERE {_unwrapped('text')} <> '' GROUP BY 1),
more AS (SELECT * FROM wrapped UNION ALL SELECT * FROM (VALUES {whole}) AS w(digest, license_id) WHERE digest NOT IN (SELECT digest FROM wrapped)),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM docs),
likely AS (SELECT r, sha256({_canonical('line')}) AS digest, sha256({_unwrapped('line')}) AS other FROM lines WHERE {stem('line')}),
found AS (SELECT r, string_agg(DISTINCT coalesce(k.license_id, m.license_id), ',' ORDER BY coalesce(k.license_id, m.license_id)) AS notices
          FROM likely l LEFT JOIN known k ON l.digest = k.digest LEFT JOIN more m ON l.other = m.digest GROUP BY r),
texts AS (SELECT r, doc_id, sha256({_canonical('text')}) AS digest, CASE WHEN {stem('text')} THEN sha256({_unwrapped('text')}) END AS other FROM docs)
SELECT doc_id, t.digest AS digest, coalesce(k.license_id, m.license_id) AS license_id, coalesce(notices, '') AS notices
FROM texts t LEFT JOIN known k ON t.digest = k.digest LEFT JOIN more m ON t.other = m.digest LEFT JOIN found USING (r)
"""


def _url_sql(z: float = 1.645, min_good: float = 0.5) -> str:
    def strength(groups: str, k: str, n: str) -> str:
        m, g = f"(sum({k}) / sum({n})::DOUBLE)", "count(*)"
        noise = f"({g} / sum({n})::DOUBLE)"
        spread = f"((sum({k} * {k} / {n}::DOUBLE) / sum({n}) - {m} * {m}) / ({m} * (1 - {m})))"
        return f"""(SELECT CASE WHEN coalesce(sum({n}), 0) <= {g} THEN 10.0 WHEN sum({k}) IN (0, sum({n})) THEN 1000.0
            ELSE 1 / least(greatest(({spread} - {noise}) / (1 - {noise}), 0.001), 0.5) - 1 END FROM {groups} WHERE {n} > 0)"""

    best = "CASE"
    for verdict, h, p in sorted(URL_RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]))):
        best += f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{verdict} {h}{p}'"
    return f"""
WITH parsed AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
outcome AS (SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels
    WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
hosts AS (SELECT host, coalesce(sum(good), 0) AS k, count(good) AS n, regexp_extract(host, '([^.]*\\.)?[^.]*$', 0) AS domain, regexp_extract(host, '[^.]*$', 0) AS suffix
    FROM parsed LEFT JOIN outcome USING (page_id) GROUP BY host),
domains AS (SELECT domain, suffix, sum(k) AS dk, sum(n) AS dn FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(dk) AS sk, sum(dn) AS sn FROM domains GROUP BY 1),
p AS (SELECT (SELECT CASE WHEN sum(sn) > 0 THEN sum(sk) / sum(sn)::DOUBLE ELSE 0.5 END FROM suffixes) AS mean,
    {strength('hosts', 'k', 'n')} AS bh, {strength('domains', 'dk', 'dn')} AS bd, {strength('suffixes', 'sk', 'sn')} AS bs),
sm AS (SELECT suffix, (sk + bs * mean) / (sn + bs) AS s_mean FROM suffixes, p),
dm AS (SELECT domain, (dk + bd * s_mean) / (dn + bd) AS d_mean FROM domains JOIN sm USING (suffix), p),
hm AS (SELECT host, (k + bh * d_mean) / (n + bh) AS m, n + bh AS size FROM hosts JOIN dm USING (domain), p),
judged AS (SELECT page_id, host, path, {best} END AS fit, m - {z} * sqrt(m * (1 - m) / (size + 1)) AS lower FROM parsed JOIN hm USING (host))
SELECT page_id, host, path, split_part(fit, ' ', 2) AS rule, CASE WHEN fit IS NOT NULL THEN split_part(fit, ' ', 1) WHEN lower >= {min_good} THEN 'allow' ELSE 'block' END AS verdict
FROM judged
"""


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Rounds are written out: b0 the first codebooks, a1, a2, ... the assignments, b1, b2, ... the codebooks after them."""

    def assigned(books: str) -> str:
        return f"""(SELECT r, p, arg_min(struct_pack(e := e, d := d), d * {entries} + e) AS best FROM
            (SELECT v.r, v.p, b.e, list_sum(list_transform(list_zip(v.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts v JOIN {books} b USING (p)) GROUP BY r, p)"""

    steps = ""
    for i in range(1, rounds + 1):
        steps += f"""
a{i} AS MATERIALIZED {assigned(f"b{i - 1}")},
m{i} AS MATERIALIZED (SELECT p, e, list(m ORDER BY j) AS c FROM (SELECT a.p, a.best.e AS e, j, floor(sum(v.x[j])::DOUBLE / count(*))::BIGINT AS m
    FROM a{i} a JOIN parts v USING (r, p), (SELECT unnest(generate_series(1, 4)) AS j) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{i} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{i - 1} b LEFT JOIN m{i} m USING (p, e)),"""
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, vec) AS r, * FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
parts AS MATERIALIZED (SELECT r, p, vec[p * 4 + 1 : p * 4 + 4] AS x FROM kept, (SELECT unnest(generate_series(0, {parts - 1})) AS p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {entries}),{steps}
last AS MATERIALIZED {assigned(f"b{rounds}")},
coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM last GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), digest
"""


def _infill_sql(seed: int = 7, rate: int = 100, spm_rate: int = 50) -> str:
    h1, h2, h3, h4 = (f"('0x' || substr(d, {i}, 8))::BIGINT" for i in (1, 9, 17, 25))
    return f"""
WITH units AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
ends AS (SELECT *, len(u) AS n, text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {h3} % 100 >= {rate} AS plain,
    least({h1} % (len(u) + 1), {h2} % (len(u) + 1)) AS a, greatest({h1} % (len(u) + 1), {h2} % (len(u) + 1)) AS b, {h4} % 100 < {spm_rate} AS spm FROM units),
pieces AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM ends)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
    sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM pieces
"""


ORACLES = {
    "op1_topk": """
WITH vectors AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.r AS q, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.vec::DOUBLE[], c.vec::DOUBLE[]) AS BIGINT) AS score
    FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND c.r <> q.r AND len(c.vec) = len(q.vec)),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op6_chat_format": f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
    (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length({_escaped('role')}) + length({_escaped('text')}) + {len('<||>') + 1 + len(chat.END)})::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
""",
    "op7_exact_dedup": """
WITH docs AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
classes AS (SELECT doc_id, sha256(norm) AS text_sha256, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
    row_number() OVER (PARTITION BY norm, doc_id) AS copy FROM docs)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND copy = 1 AS kept, text_sha256 FROM classes
""",
    "op8_license_scan": _license_sql(),
    "op10_url_filter": _url_sql(),
    "op11_infill": _infill_sql(),
    "op13_codes": _codes_sql(),
}
