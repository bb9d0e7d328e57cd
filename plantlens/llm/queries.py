"""One query for each operator, over its whole table, with a DuckDB twin where SQL can state the result."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import functions as F

from . import chatformat, cuckoo, jaccard, langid, licenses, merkle, packing, pii, runs, sharding, simple8b, superkmer, winnow
from .registry import query

def tokenizer_file(name: str) -> str:
    return import_module("public_tokenizers").path(name)


@query("op1_pack")
def pack(read):
    return packing.pack(read("documents"), tokenizer_file("byte_bpe_50k.json")).drop("ids")


@query("op3_token_files")
def token_files(read):
    return simple8b.round_trip(read("documents"), tokenizer_file("word_bpe_49k.json"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


@query("op9_exact_dedup", OP9_SQL)
def exact_dedup(read):
    rows = cuckoo.dedup(read("documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bwin AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM bwin
), dpos AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)
), occ AS (SELECT doc_id, i, d.size, item_id FROM dpos d JOIN bwin b ON d.size = b.size AND d.win = b.win
), hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM occ) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query("op10_decontaminate", OP10_SQL)
def decontaminate(read):
    return winnow.contamination(read("documents"), read("benchmark"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), s AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) < doc_id AS dup FROM p
), k AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM s WHERE dup
), x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d
), y AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.k) FILTER (k.k IS NULL) AS kept, count(k.k) AS gone
  FROM x LEFT JOIN k USING (doc_id, k) GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN y USING (doc_id)
"""


@query("op4_substring_dedup", OP4_SQL)
def substring_dedup(read):
    found = superkmer.remove_repeats(read("documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 3], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, two.b FROM r JOIN two ON r.b = two.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) USING (doc_id)
"""


@query("op8_jaccard_join", OP8_SQL)
def jaccard_join(read):
    return jaccard.near_duplicates(read("documents"))


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, contains(role || '|' || text, '###') OR contains(role || '|' || text, '</turn>') OR contains(role, chr(10)) AS coded FROM c
), f AS (
  SELECT *, 13 + CASE WHEN coded
    THEN length(replace(replace(replace(replace(role, '\', '\\'), '#', '\h'), '<', '\l'), chr(10), '\n')) + length(replace(replace(replace(text, '\', '\\'), '#', '\h'), '<', '\l'))
    ELSE length(role) + length(text) END AS size
  FROM s
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


@query("op2_chat_format", OP2_SQL)
def chat_format(read):
    turns = read("conversations").select("conv_id", "turn", "role", "text")
    two = turns.sparkSession.range(2)
    hard = two.select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return chatformat.read_back(chatformat.format_chats(turns.unionByName(hard)))


@query("op7_shard")
def shard(read):
    found = sharding.place(read("documents"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op5_license_scan")
def license_scan(read):
    found = licenses.scan(read("documents"))
    return found.select(
        "doc_id", "n_words", F.size("found").cast("bigint").alias("n_found"), F.array_join(F.transform("found", lambda f: f["license"]), ",").alias("licenses"),
        F.array_max(F.transform("found", lambda f: f["coverage"])).alias("best_coverage"),
        F.array_join(F.transform("found", lambda f: F.array_join(F.transform(f["places"], lambda p: F.concat_ws("-", p["start"], p["end"])), ";")), ",").alias("ranges"),
    )


@query("op6_language_id")
def language_id(read):
    docs = read("documents").select("doc_id", "text", "lang")
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("row.doc_id", "held_out", "lang_pred", "score")


CRC_SQL = """list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
    lambda c, x: list_reduce([xor(c, x), 1, 1, 1, 1, 1, 1, 1, 1], lambda a, b: xor(a >> 1, 3988292384::UBIGINT * (a & 1))))"""

OP11_SQL = f"""
WITH RECURSIVE f AS (
  SELECT coalesce('l' || lang, '') AS g, doc_id, text, n_chars, xor({CRC_SQL}, 4294967295::UBIGINT) % 7 = 0 AS hit,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(text) || ':' || text, '-') AS z
  FROM documents
), l AS (
  SELECT g, doc_id, sha256(a || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || z) AS leaf,
    sha256(a || coalesce(strlen(CAST(n_chars + CAST(hit AS INT) AS VARCHAR)) || ':' || (n_chars + CAST(hit AS INT)), '-') || z) AS leaf2
  FROM f
), p AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM l
), t AS (
  SELECT g, 0 AS lev, pos AS i, leaf AS h, n FROM p
  UNION ALL
  SELECT g, lev + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY g, lev, i // 2
), s AS (
  SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1
), u AS (
  SELECT 0 AS lev, pos AS i, h, n FROM s
  UNION ALL
  SELECT lev + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY lev, i // 2
), v AS (  -- siblings of every node of both trees, numbered upwards
  SELECT x.g, x.lev, x.i, y.h AS sib, x.i % 2 AS odd FROM t x LEFT JOIN t y ON y.g = x.g AND y.lev = x.lev AND y.i = xor(x.i, 1) WHERE x.n > 1
), w AS (
  SELECT x.lev, x.i, y.h AS sib, x.i % 2 AS odd FROM u x LEFT JOIN u y ON y.lev = x.lev AND y.i = xor(x.i, 1) WHERE x.n > 1
), low AS (
  SELECT p.g, p.pos, v.lev, v.sib, v.odd FROM p JOIN v ON v.g = p.g AND v.i = p.pos >> v.lev
), high AS (
  SELECT s.g, w.lev, w.sib, w.odd FROM s JOIN w ON w.i = s.pos >> w.lev
), step AS (
  SELECT g, pos, row_number() OVER (PARTITION BY g, pos ORDER BY part, lev) AS k, sib, odd
  FROM (SELECT g, pos, 0 AS part, lev, sib, odd FROM low UNION ALL SELECT p.g, p.pos, 1, h.lev, h.sib, h.odd FROM p JOIN high h USING (g))
), fold AS (
  SELECT g, pos, 0 AS k, leaf2 AS h FROM p
  UNION ALL
  SELECT f.g, f.pos, f.k + 1, sha256(CASE WHEN odd = 1 THEN sib || h ELSE h || coalesce(sib, '') END)
  FROM fold f JOIN step ON step.g = f.g AND step.pos = f.pos AND step.k = f.k + 1
), proof AS (SELECT g, pos, string_agg(coalesce(sib, ''), '' ORDER BY k) AS sibs, max(k) AS top FROM step GROUP BY g, pos
), root AS (SELECT h AS root FROM u WHERE n = 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, root, sha256(coalesce(sibs, '')) AS proof_sha256, fold.h AS folded_root, fold.h = root AS verified
FROM p JOIN s USING (g) CROSS JOIN root LEFT JOIN proof ON proof.g = p.g AND proof.pos = p.pos
JOIN fold ON fold.g = p.g AND fold.pos = p.pos AND fold.k = coalesce(top, 0)
"""


@query("op11_merkle_manifest", OP11_SQL)
def merkle_manifest(read):
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    changed = F.when(hit & F.col("n_chars").isNotNull(), merkle.leaf_of(n_chars=F.col("n_chars") + 1))
    return merkle.manifest(read("documents"), changed).drop("proof", "copied")


@query("op12_pii")
def personal_data(read):
    found = pii.extract(read("documents"))
    counts = [pii.counted(F.col("base"), kind).alias(f"n_{name}") for kind, name in enumerate(pii.KINDS)]
    base = F.sha2(pii.spelled(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, pii.spelled(F.concat("base", "found")).alias("spans"))


OP13_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS o, xor({CRC_SQL}, 4294967295::UBIGINT)::BIGINT AS h FROM documents
), e AS (
  SELECT doc_id, o, len(o) AS n, h % 10 = 0 AND len(o) > 0 AS hit, h // 10 AS g, (h // 10) % greatest(len(o), 1) AS a FROM d
), w AS (
  SELECT doc_id, n, CASE WHEN hit
    THEN list_transform(range(n), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE o END AS w
  FROM e
), gram AS (
  SELECT doc_id, i, hash(array_to_string(w[i + 1 : i + 6], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(n - 5)) AS i FROM w WHERE n >= 6)
), same AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM gram x JOIN gram y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i
), island AS (
  SELECT doc_id, q, min(i) AS l, max(i) + 6 + q AS r
  FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS z FROM same) GROUP BY doc_id, q, z
), run AS (
  SELECT doc_id, l, r, min(q) AS q FROM island WHERE r - l >= greatest(12, 2 * q) GROUP BY doc_id, l, r
), top AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(l || ',' || (r - l) || ',' || q || chr(10), '' ORDER BY l, q) AS listed,
    arg_min(struct_pack(l := l, n := r - l, q := q), row(l - r, l, q)) AS best
  FROM run GROUP BY doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(l + q, r)) AS i FROM run
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM w) x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.l AS start, best.n AS length, best.q AS period, 1000 * best.n // best.q AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN top USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op13_periodic_runs", OP13_SQL)
def periodic_runs(read):
    return runs.periodic(runs.plant(read("documents")), whole=False).drop("n_words", "runs", "collapsed")
