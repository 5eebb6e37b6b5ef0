"""The opN queries: thin digests over the operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, chroma, cross_align, decontaminate, fim, packing, piece_encoding, quality_gbt, rindex_dedup, signature_join, suffix_dedup, toxicity_gru, url_rules
from .common import table, written


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.canonical_turns(table(spark, sf_dir, "conversations"))
    control = f"{chat_format.END}{chat_format.START}assistant ok"
    extra = spark.sql("SELECT id AS turn FROM range(2)").select(F.lit(-1).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(F.col("turn") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    made = chat_format.format_chat(turns.unionByName(extra))
    back = chat_format.read_back(made)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, replace(replace(role, '\', '\\'), '<|', '<\|') AS er, replace(replace(text, '\', '\\'), '<|', '<\|') AS et FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(33 + length(er) + length(et)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

#: Fixed rules of the query: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


OP9_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT *, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r"""


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.phrase_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))).cast("long")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
win AS (SELECT item, w[i : i + 9] AS phrase FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w FROM documents),
lens AS (SELECT DISTINCT len(phrase) AS n FROM win),
g AS (SELECT rid, n, i, w[i : i + n - 1] AS phrase FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT g.rid, g.i, g.n, win.item FROM g JOIN win ON g.phrase = win.phrase),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN its USING (rid)"""


def op2_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.near_duplicates(table(spark, sf_dir, "documents"), 5, 80)


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sh AS (SELECT DISTINCT rid, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
links AS (SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS k FROM sh x JOIN sh y ON x.g = y.g AND x.rid <> y.rid GROUP BY 1, 2) JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
reach(rid, other) AS (SELECT rid, rid FROM n UNION SELECT r.rid, l.b FROM reach r JOIN links l ON l.a = r.other),
low AS (SELECT r.rid, min(d.doc_id) AS c FROM reach r JOIN d ON d.rid = r.other GROUP BY 1)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id FROM d LEFT JOIN n USING (rid) LEFT JOIN low USING (rid)"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"), 35)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT rid, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT rid, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM rep),
gl AS (SELECT rid, list(p) AS ps, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(ps, p)), lambda p: w[p]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gl USING (rid)"""


def op4_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chroma.search(chroma.fingerprints(chroma.rendered(table(spark, sf_dir, "embeddings")), "rec", "wav"), every=20)
    return found.select(F.col("rec").alias("vec_id"), "class_id", F.size("fp").cast("long").alias("n_fingerprints"), F.sha2(F.array_join(F.col("fp").cast("array<string>"), ","), 256).alias("fingerprint_sha256"), F.size("matches").cast("long").alias("n_matches"), "matches")


def op5_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_gbt.train(docs, labels, "quality", modulus=4, held_out=2)
    scored = quality_gbt.classify(docs, model, threshold=0.7)
    return scored.select("doc_id", (quality_gbt.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op6_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity_gru.train(docs, labels, "toxic", modulus=5, held_out=0)
    scored = toxicity_gru.classify(docs, model, threshold=0.5)
    return scored.select("doc_id", (quality_gbt.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


#: The tokenizer's place is a parameter; by default the installed public vocabulary files.
TOKENIZER = "word_bpe_49k.json"


def op7_pattern_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    import public_tokenizers

    cut = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path or public_tokenizers.path(TOKENIZER), 2048, 0)
    return packing.pack(cut, 2048)


def op8_rindex_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rindex_dedup.dedup(table(spark, sf_dir, "documents"), 50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as hexadecimal digits; texts are cut into overlapping chunks first, so that no digit is looked for from the start of a long text.
OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT rid, k, o, substr(h, 2 * o + 1, 1122) AS part, length(h) // 2 - o AS n FROM (SELECT rid, k, h, unnest(range(0, greatest(length(h) // 2, 1), 512)) AS o FROM d)),
win AS (SELECT rid, k, o + j AS i, md5(substr(part, 2 * j + 1, 100)) AS w FROM (SELECT rid, k, o, part, unnest(range(0, least(512, n - 49))) AS j FROM c WHERE n >= 50)),
hit AS (SELECT rid, i FROM win JOIN (SELECT w, min(k) AS least FROM win GROUP BY w) USING (w) WHERE k > least),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM hit),
spans AS (SELECT rid, count(*) AS n, count(*) FILTER (WHERE before IS NULL OR before < p - 1) AS s FROM (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS before FROM gone) GROUP BY rid),
bytes AS (SELECT rid, o + j AS p, substr(part, 2 * j + 1, 2) AS x FROM (SELECT rid, o, part, unnest(range(0, least(512, n))) AS j FROM c WHERE rid IN (SELECT rid FROM spans))),
kept AS (SELECT rid, string_agg(x, '' ORDER BY p) AS h FROM bytes ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(spans.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(s, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN spans.n IS NULL THEN d.h ELSE coalesce(kept.h, '') END)) AS kept_sha256
FROM d LEFT JOIN spans USING (rid) LEFT JOIN kept USING (rid)"""


#: Vocabulary files of the queries; every operator takes their places as parameters.
PIECES, BYTE_LEVEL = "piece_bpe_32k.model", "byte_bpe_50k.json"


def op11_piece_encoding(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    import public_tokenizers

    path = model_path or public_tokenizers.path(PIECES)
    back = piece_encoding.decode(piece_encoding.encode(table(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"), seed=42, fim_percent=50, spm_percent=80)
    made = made.withColumn("output_sha256", F.sha2("output", 256))
    columns = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")
    return fim.restore(made, *columns).select(*columns, F.sha2("restored", 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS x, greatest(h1 % (n + 1), h2 % (n + 1)) AS y,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1 : x], '') AS prefix, array_to_string(u[x + 1 : y], '') AS middle, array_to_string(u[y + 1 :], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""


def op13_cross_alignment(spark: SparkSession, sf_dir: str, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    import public_tokenizers

    return cross_align.link_figures(table(spark, sf_dir, "documents"), a_path or public_tokenizers.path(BYTE_LEVEL), b_path or public_tokenizers.path(PIECES))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    names = {k.split("_")[0].upper(): k for k in queries()}
    return {names[k[:-4]]: v for k, v in globals().items() if k.endswith("_SQL") and k[:-4] in names}
