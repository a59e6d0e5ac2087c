"""Queries on whole corpora: splits, shuffles, joins, statistics, batches, vectors and mixed representations."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqprep.functions import arrays as AR
from seqprep.functions import phones as PH
from seqprep.functions import symbols as S
from seqprep.functions import text as T
from seqprep.operators import aggregates as AG
from seqprep.operators import batching as B
from seqprep.operators import filters as FL
from seqprep.operators import joins as J
from seqprep.operators import mix as MX
from seqprep.operators import sampling as K
from seqprep.operators import vectors as VQ
from seqprep.plans import sql as Q
from seqprep.plans import views as V
from seqprep.plans.registry import query

r = Q.r


def rounded(c, n=6):
    return F.round(c, n)


def ids(spark, folder):
    return V.table(spark, folder, "documents").select("doc_id")


# -- sampling ---------------------------------------------------------------------------------------------------------
RANKED = "k AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS rank, count(*) OVER () AS total FROM documents)"


@query("sample_shuffle_split", f"WITH {RANKED} SELECT doc_id, rank, 'train' AS part FROM k WHERE rank < floor(total * 0.9) UNION ALL SELECT doc_id, rank, 'valid' FROM k WHERE rank >= floor(total * 0.9)")
def shuffle_split(spark, folder):
    train = K.shuffle_split(ids(spark, folder), ["doc_id"], 0.0, 0.9, 7).withColumn("part", F.lit("train"))
    return train.unionByName(K.shuffle_split(ids(spark, folder), ["doc_id"], 0.9, None, 7).withColumn("part", F.lit("valid")))


@query("sample_approximate_split", "SELECT doc_id FROM documents WHERE ('0x' || left(md5('7:' || doc_id), 8))::BIGINT < floor(0.25 * 4294967296)")
def approximate_split(spark, folder):
    return K.approximate_split(ids(spark, folder), ["doc_id"], 0.0, 0.25, 7)


@query("sample_train_test_split", f"WITH {RANKED} SELECT doc_id, rank, CASE WHEN rank < 37 THEN 'test' ELSE 'train' END AS split FROM k")
def train_test_split(spark, folder):
    return K.train_test_split(ids(spark, folder), ["doc_id"], 37, 7)


@query("sample_index_range_split", """
SELECT vec_id, rank, CASE WHEN rank < floor(n * 0.625::DOUBLE) THEN 'train' WHEN rank < floor(n * 0.8125::DOUBLE) THEN 'valid' ELSE 'test' END AS split
FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS rank, count(*) OVER () AS n FROM embeddings)""")
def index_range_split(spark, folder):
    e = V.table(spark, folder, "embeddings").select("vec_id")
    return K.index_range_split(e, ["vec_id"], {"train": (0, 0.625), "valid": (0.625, 0.8125), "test": (0.8125, None)})


@query("sample_batch", """
SELECT vec_id, b::INT AS batch FROM (SELECT vec_id, b, row_number() OVER (PARTITION BY b ORDER BY md5('3:' || b || ':' || vec_id)) AS n FROM embeddings, (SELECT unnest(range(0, 3)) AS b)) WHERE n <= 16""")
def sample_batch(spark, folder):
    return K.sample_batches(V.table(spark, folder, "embeddings").select("vec_id"), ["vec_id"], 16, 3, 3)


def skip_sql(n, seed, batches, where="true"):
    """Offers of every row by drawn gaps, and the first n of each batch."""
    u = f"(('0x' || left(md5('{seed}:gap:' || j || ':' || vec_id), 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE"
    gap = lambda j: f"CASE WHEN p < 1 THEN floor(ln({u.replace('|| j ||', f'|| {j} ||')}) / ln(1 - p))::BIGINT ELSE 0 END"
    return f"""
WITH RECURSIVE rows AS (SELECT vec_id, least(1.0, ({n} + 8 * sqrt({n}) + 16) / count(*) OVER ())::DOUBLE AS p FROM embeddings WHERE {where}),
draws AS (SELECT vec_id, p, 0 AS j, {gap('0')} AS b FROM rows UNION ALL SELECT vec_id, p, j + 1, b + 1 + {gap('(j + 1)')} FROM draws WHERE b < {batches})
SELECT vec_id, b::INT AS batch FROM (SELECT vec_id, b, row_number() OVER (PARTITION BY b ORDER BY md5('{seed}:' || b || ':' || vec_id), vec_id) AS k FROM draws WHERE b < {batches}) WHERE k <= {n}"""


@query("sample_skip_batches", skip_sql(16, 7, 500))
def skip_batches(spark, folder):
    return K.skip_batches(V.table(spark, folder, "embeddings").select("vec_id"), ["vec_id"], 16, 7, 500)


SIMILAR = """
r AS (SELECT doc_id, row_number() OVER (ORDER BY len(text), doc_id) - 1 AS rk, count(*) OVER () AS total FROM documents),
z AS (SELECT *, least(4 * 32, total) - least(4 * 32, total) % 4 AS size FROM r), g AS (SELECT *, rk >= total // size * size AS tail, rk // size AS grp FROM z),
p AS (SELECT doc_id, tail, grp * size + row_number() OVER (PARTITION BY grp, tail ORDER BY md5('5:' || doc_id), doc_id) - 1 AS i FROM g),
b AS (SELECT bt, row_number() OVER (ORDER BY md5('5:batch:' || bt), bt) - 1 AS nb FROM (SELECT DISTINCT i // 4 AS bt FROM p WHERE NOT tail))
"""


@query("sample_similar_length_order", f"WITH {SIMILAR} SELECT doc_id, (CASE WHEN tail THEN i ELSE nb * 4 + i % 4 END)::BIGINT AS place FROM p LEFT JOIN b ON b.bt = p.i // 4")
def similar_length_order(spark, folder):
    d = V.table(spark, folder, "documents").select("doc_id", F.length("text").alias("n"))
    return K.similar_length_order(d, ["doc_id"], F.col("n"), 4, 5).select("doc_id", "place")


GROUPED = "k AS (SELECT conv_id, turn, row_number() OVER (ORDER BY md5('9:' || conv_id), conv_id, turn, role, md5(text)) - 1 AS place, count(*) OVER () AS total FROM conversations)"


def turns(spark, folder):
    return V.table(spark, folder, "conversations").select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("h"))


@query("sample_grouped_shuffle", f"WITH {GROUPED} SELECT conv_id, turn, place FROM k WHERE place < total - total % 8")
def grouped_shuffle(spark, folder):
    return K.grouped_shuffle(turns(spark, folder), "conv_id", ["turn", "role", "h"], 8, 9).select("conv_id", "turn", "place")


@query("batch_grouped", f"WITH {GROUPED} SELECT conv_id, turn, place // 8 AS batch FROM k WHERE place < total - total % 8")
def grouped_batches(spark, folder):
    return B.grouped_batches(turns(spark, folder), "conv_id", ["turn", "role", "h"], 8, 9).select("conv_id", "turn", "batch")


@query("sample_per_key_cap", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 5")
def per_key_cap(spark, folder):
    return K.per_key_cap(V.table(spark, folder, "documents").select("doc_id", "source"), "source", ["doc_id"], 5)


# -- joins, sets and filters ------------------------------------------------------------------------------------------
WAV = "SELECT DISTINCT 'f' || doc_id % 700 AS stem, 'f' || doc_id % 700 || '.' || lang || '.wav' AS name, '/d' || doc_id % 3 || '/f' || doc_id % 700 || '.' || lang || '.wav' AS path FROM documents"
TXT = "SELECT DISTINCT 'f' || doc_id % 900 AS stem, 'f' || doc_id % 900 || '.json' AS name, '/t/' || quality || '/f' || doc_id % 900 || '.json' AS path FROM labels"


def wav_files(spark, folder):
    d = V.table(spark, folder, "documents")
    return d.select(F.concat(F.lit("/d"), (F.col("doc_id") % 3).cast("string"), F.lit("/f"), (F.col("doc_id") % 700).cast("string"), F.lit("."), F.col("lang"), F.lit(".wav")).alias("path"))


def txt_files(spark, folder):
    d = V.table(spark, folder, "labels")
    return d.select(F.concat(F.lit("/t/"), F.col("quality").cast("string"), F.lit("/f"), (F.col("doc_id") % 900).cast("string"), F.lit(".json")).alias("path"))


@query("join_pair_by_stem", f"""
WITH a AS (SELECT stem, (array_agg(path ORDER BY encode(name) DESC, encode(path) DESC))[1] AS wav_path FROM ({WAV}) GROUP BY stem), b AS (SELECT stem, (array_agg(path ORDER BY encode(name) DESC, encode(path) DESC))[1] AS txt_path FROM ({TXT}) GROUP BY stem)
SELECT * FROM a JOIN b USING (stem)""")
def pair_by_stem(spark, folder):
    return J.pair_by_stem(wav_files(spark, folder), txt_files(spark, folder))


@query("join_prune", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def prune(spark, folder):
    d, lab = V.table(spark, folder, "documents").select("doc_id", "source"), V.table(spark, folder, "labels").where("toxic = 1")
    return J.prune(d, lab, ["doc_id"])


@query("join_shared_ids", "SELECT doc_id FROM documents WHERE 1 = 0")
def shared_ids(spark, folder):
    d = ids(spark, folder)
    train, valid = K.shuffle_split(d, ["doc_id"], 0.0, 0.9, 7), K.shuffle_split(d, ["doc_id"], 0.9, None, 7)
    J.assert_disjoint(train, valid, ["doc_id"])
    return J.shared_ids(train, valid, ["doc_id"])


@query("join_shared_ids_overlap", "SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def shared_ids_overlap(spark, folder):
    return J.shared_ids(V.table(spark, folder, "documents").where("lang = 'en'"), V.table(spark, folder, "labels").where("quality = 1"), ["doc_id"])


@query("join_symbol_lookup", f"""
SELECT doc_id, {Q.csv(Q.ids_of("string_split(lower(text), '')", 'char'))} AS ids, array_to_string(list_filter(string_split(lower(text), ''), lambda c: c <> '' AND instr({Q.lit(S.CHARS)}, c) > 0), '') AS back FROM documents""")
def symbol_lookup(spark, folder):
    d = V.table(spark, folder, "documents").select("doc_id", J.symbol_lookup(F.split(F.lower("text"), ""), "char").alias("i"))
    return d.select("doc_id", F.array_join(F.col("i").cast("array<string>"), ",").alias("ids"), S.ids_to_text(F.col("i")).alias("back"))


@query("set_shared_keys", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def shared_keys(spark, folder):
    return J.shared_keys(V.table(spark, folder, "documents"), V.table(spark, folder, "labels"), "doc_id")


@query("set_concat_parts", "SELECT vec_id, 0 AS part FROM embeddings WHERE label < 7 UNION ALL SELECT vec_id, 1 FROM embeddings WHERE label >= 7")
def concat_parts(spark, folder):
    e = V.table(spark, folder, "embeddings")
    return J.concat_parts(e.where("label < 7").select("vec_id"), e.where("label >= 7").select("vec_id"))


@query("set_charset_union", "SELECT DISTINCT c AS symbol FROM (SELECT unnest(string_split(text, '')) AS c FROM documents UNION ALL SELECT unnest(string_split(text, '')) FROM conversations) WHERE c <> ''")
def charset_union(spark, folder):
    return J.charset_union(V.table(spark, folder, "documents").select("text"), V.table(spark, folder, "conversations").select("text"))


@query("filter_speaker", "SELECT doc_id, n_chars FROM documents WHERE source = (SELECT min(source) FROM documents)")
def speaker_filter(spark, folder):
    d = V.table(spark, folder, "documents").select("doc_id", "n_chars", "source")
    first = V.table(spark, folder, "documents").agg(F.min("source")).scalar()
    return FL.speaker_filter(d, first, "source")


# -- statistics -------------------------------------------------------------------------------------------------------
DIMS = "e AS (SELECT vec_id, label, i - 1 AS dim, embedding[i]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"


@query("agg_masked_mean_std", f"WITH {DIMS} SELECT dim::INT AS dim, {r('avg(v)')} AS mean, {r('stddev_pop(v)')} AS std, count(*)::BIGINT AS n FROM e WHERE label <> 3 GROUP BY dim")
def masked_mean_std(spark, folder):
    f = V.frames(spark, folder).withColumn("mask", (F.col("label") != 3).cast("int"))
    return AG.masked_mean_std(f, "feat", "mask").withColumn("mean", rounded("mean")).withColumn("std", rounded("std"))


@query("agg_merge_mean_var", f"WITH {DIMS} SELECT dim::INT AS dim, count(*)::BIGINT AS n, {r('avg(v)')} AS mean, {r('var_pop(v)')} AS var FROM e GROUP BY dim")
def merge_mean_var(spark, folder):
    f = V.frames(spark, folder)
    parts = AG.mean_var_state(f, "feat", ["label"])
    m = AG.merge_mean_var(parts.where("label < 4").drop("label"), parts.where("label >= 4").drop("label"))
    return m.select("dim", "n", rounded("mean").alias("mean"), rounded(F.col("m2") / F.col("n")).alias("var"))


@query("agg_normalize", f"WITH {DIMS}, s AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS s FROM e GROUP BY dim) SELECT vec_id, dim::INT AS dim, {r('(v - m) / s')} AS z, {r('v')} AS back FROM e JOIN s USING (dim)")
def normalize(spark, folder):
    f = V.frames(spark, folder)
    stats = AG.masked_mean_std(f)
    z = AG.normalize(f, stats)
    back = AG.denormalize(z, stats).select("vec_id", F.col("feat").alias("b"))
    x = z.join(back, "vec_id").select("vec_id", F.posexplode(F.arrays_zip("feat", "b")).alias("dim", "q"))
    return x.select("vec_id", "dim", rounded("q.feat").alias("z"), rounded("q.b").alias("back"))


@query("agg_group_rows", "SELECT conv_id, 0::BIGINT AS piece, array_to_string(list_sort(list(turn)), ',') AS ids FROM conversations GROUP BY conv_id")
def group_rows(spark, folder):
    g = AG.group_rows(V.table(spark, folder, "conversations"), "conv_id", "turn")
    return g.select("conv_id", "piece", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("array_one_hot", "SELECT vec_id, array_to_string(list_transform(range(0, 10), lambda i: CASE WHEN i = label THEN 1 ELSE 0 END), '') AS hot FROM embeddings")
def one_hot(spark, folder):
    e = V.table(spark, folder, "embeddings")
    return e.select("vec_id", F.array_join(AR.one_hot(F.col("label"), 10).cast("array<int>").cast("array<string>"), "").alias("hot"))


@query("array_zero_frame_mask", "SELECT vec_id, (CASE WHEN label <> 2 THEN 1 ELSE 0 END)::INT AS mask FROM embeddings")
def zero_frame_mask(spark, folder):
    f = V.frames(spark, folder).withColumn("feat", F.transform(F.col("feat").cast("array<double>"), lambda v: F.when(F.col("label") == 2, 0.0).otherwise(v)))
    return f.select("vec_id", AR.zero_frame_mask(F.col("feat")).alias("mask"))


# -- vectors ----------------------------------------------------------------------------------------------------------
# The codebook holds the mean vector of every label.
BOOK = f"{DIMS}, b AS (SELECT label AS code_id, dim, avg(v) AS v FROM e GROUP BY ALL), d AS (SELECT e.vec_id, b.code_id, sum(pow(e.v - b.v, 2)) AS d FROM e JOIN b USING (dim) GROUP BY ALL), n AS (SELECT vec_id, (array_agg(code_id ORDER BY d, code_id))[1]::BIGINT AS code_id, min(d) AS d FROM d GROUP BY vec_id)"


def codebook(spark, folder):
    means = V.frames(spark, folder).select("label", F.posexplode("feat").alias("dim", "v")).groupBy("label", "dim").agg(F.avg(F.col("v").cast("double")).alias("v"))
    rows = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("dim", "v"))).alias("_v"))
    return rows.select(F.col("label").cast("long").alias("code_id"), F.col("_v.v").alias("vec"))


@query("vector_nearest_codeword", f"WITH {BOOK} SELECT vec_id, code_id, {r('d')} AS distance FROM n")
def nearest_codeword(spark, folder):
    rows = V.frames(spark, folder).select("vec_id", F.col("feat").cast("array<double>").alias("vec"))
    x = VQ.nearest_codeword(rows, codebook(spark, folder))
    return x.select("vec_id", "code_id", rounded("distance").alias("distance"))


@query("vector_nearest_codeword_columns", f"WITH {BOOK} SELECT vec_id, code_id, {r('d')} AS distance FROM n")
def nearest_codeword_columns(spark, folder):
    rows = V.frames(spark, folder).select("vec_id", F.col("feat").alias("vec"))
    x = VQ.nearest_codeword_columns(rows, codebook(spark, folder))
    return x.select("vec_id", "code_id", rounded("distance").alias("distance"))


@query("vector_quantization_error", f"WITH {BOOK} SELECT {r('sum(d)')} AS error, count(*)::BIGINT AS n FROM n")
def quantization_error(spark, folder):
    rows = V.frames(spark, folder).select("vec_id", F.col("feat").cast("array<double>").alias("vec"))
    return VQ.quantization_error(VQ.nearest_codeword(rows, codebook(spark, folder))).withColumn("error", rounded("error"))


def lloyd_sql(steps: int) -> str:
    """Assignments and centers of the steps, one after the other."""
    parts = [
        "f AS (SELECT vec_id, i - 1 AS dim, embedding[i]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i))",
        "c0 AS (SELECT code_id, dim, v FROM (SELECT vec_id, row_number() OVER (ORDER BY md5('1:' || vec_id)) - 1 AS code_id FROM embeddings) JOIN f USING (vec_id) WHERE code_id < 8)",
    ]
    for s in range(steps + 1):
        parts.append(f"d{s} AS MATERIALIZED (SELECT vec_id, code_id, sum((f.v - c{s}.v) * (f.v - c{s}.v)) AS d FROM f JOIN c{s} USING (dim) GROUP BY ALL)")
        parts.append(f"a{s} AS MATERIALIZED (SELECT vec_id, code_id, d FROM d{s} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, code_id) = 1)")
        means = f"SELECT code_id, dim, avg(v) AS mean FROM a{s} JOIN f USING (vec_id) GROUP BY ALL"
        parts.append(f"c{s + 1} AS MATERIALIZED (SELECT code_id, dim, coalesce(mean, v) AS v FROM c{s} LEFT JOIN ({means}) USING (code_id, dim))")
    return "WITH " + ",\n".join(parts)


@query("vector_kmeans", f"{lloyd_sql(3)} SELECT code_id, count(*)::BIGINT AS n, {r('sum(d)', 4)} AS cost FROM a3 GROUP BY code_id")
def kmeans(spark, folder):
    """Three Lloyd steps from the eight vectors with the smallest md5."""
    rows = V.frames(spark, folder).select("vec_id", F.col("feat").cast("array<double>").alias("vec"))
    first = K.shuffle_rank(rows, ["vec_id"], 1).where("rank < 8").select(F.col("rank").alias("code_id"), "vec")
    book = VQ.lloyd(rows, first, 3)
    return VQ.nearest_codeword(rows, book).groupBy("code_id").agg(F.count("*").alias("n"), rounded(F.sum("distance"), 4).alias("cost"))


@query("vector_roundtrip", """
WITH f AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding FROM embeddings),
s AS (SELECT label, frame // 2 AS frame, count(*) AS n FROM f GROUP BY ALL HAVING count(*) = 2),
e AS (SELECT f.label, f.frame // 2 AS st, f.frame % 2 AS h, i - 1 AS dim, f.embedding[i]::DOUBLE AS v FROM f JOIN s ON s.label = f.label AND s.frame = f.frame // 2, (SELECT unnest(range(1, 65)) AS i)),
c AS (SELECT label, i - 1 AS dim, avg(embedding[i]::DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), b AS (SELECT label AS code_id, h, dim, v + h AS v FROM c, (SELECT unnest([0, 1]) AS h)),
d AS (SELECT e.label, e.st, b.code_id, sum(pow(e.v - b.v, 2)) AS d FROM e JOIN b USING (h, dim) GROUP BY ALL),
n AS (SELECT label, st, (array_agg(code_id ORDER BY d, code_id))[1] AS code_id FROM d GROUP BY label, st)
SELECT n.label, n.st * 2 + b.h AS frame, (round(sum(b.v), 5) + 0.0) AS total FROM n JOIN b USING (code_id) GROUP BY n.label, n.st, b.h""")
def vq_roundtrip(spark, folder):
    from seqprep.operators.blocks import position

    f = V.frames(spark, folder).withColumn("feat", F.col("feat").cast("array<double>"))
    frames = position(f, ["label"], ["vec_id"], "frame").select("label", "frame", "feat")
    book = codebook(spark, folder).withColumn("vec", F.concat("vec", F.transform("vec", lambda v: v + 1)))
    out = VQ.vq_roundtrip(frames, book, ["label"], 2)
    return out.select("label", "frame", F.round(F.aggregate("feat", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


# -- chunks and batches -----------------------------------------------------------------------------------------------
SIG = f"WITH {Q.SIGNAL}, n AS (SELECT utt, count(*) AS n FROM signal GROUP BY utt)"


@query("batch_chunk_overlap1", f"{SIG}, c AS (SELECT utt, unnest(range(0, (n - 1) // 10)) AS chunk FROM n) SELECT c.utt, c.chunk, (s.pos - c.chunk * 10)::INT AS step, s.pos, s.x FROM c JOIN signal s ON s.utt = c.utt AND s.pos BETWEEN c.chunk * 10 AND c.chunk * 10 + 10")
def chunk_overlap1(spark, folder):
    return B.chunk_overlap1(V.samples(spark, folder), ["utt"], 10)


@query("batch_chunk_padded", f"{SIG}, c AS (SELECT utt, unnest(range(0, (n + 9) // 10 * 10)) AS pos FROM n) SELECT c.utt, c.pos // 10 AS chunk, (c.pos % 10)::INT AS step, coalesce(s.x, 0.0) AS x, (s.x IS NOT NULL)::INT AS mask FROM c LEFT JOIN signal s USING (utt, pos)")
def chunk_padded(spark, folder):
    return B.chunk_padded(V.samples(spark, folder), ["utt"], 10)


@query("batch_assign_lanes", f"""{SIG}, q AS (SELECT utt, ((n + 9) // 10) AS n_chunks, row_number() OVER (ORDER BY md5('1:' || utt), utt) - 1 AS rk FROM n),
f AS (SELECT *, rk % 4 AS lane, coalesce(sum(n_chunks) OVER (PARTITION BY rk % 4 ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM q)
SELECT utt, lane::INT AS lane, c::INT AS chunk, (first + c)::BIGINT AS batch, (CASE WHEN c = 0 AND rk >= 4 THEN 0 ELSE 1 END)::INT AS reset FROM (SELECT *, unnest(range(0, n_chunks)) AS c FROM f)""")
def assign_lanes(spark, folder):
    n = V.samples(spark, folder).groupBy("utt").agg(F.count("*").alias("n"))
    seq = n.select("utt", F.expr("(n + 9) div 10").alias("n_chunks"), K.hash_order(1, "utt").alias("h"))
    out = B.assign_lanes(seq, ["h", "utt"], 4)
    return out.select("utt", "lane", F.col("chunk").cast("int").alias("chunk"), "batch", "reset")


@query("batch_pad", f"""
WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY len(text), doc_id) - 1 AS rk, {Q.char_ids("lower(text)")} || [1] AS ids FROM documents), b AS (SELECT *, rk // 8 AS batch FROM k), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS longest FROM b)
SELECT doc_id, batch, len(ids)::INT AS length, longest::INT AS longest, list_sum(ids)::BIGINT AS total, md5(array_to_string(ids, ',') || repeat(',0', (longest - len(ids))::INT)) AS padded FROM m""")
def pad_batch(spark, folder):
    from seqprep.operators.blocks import position

    d = V.documents(spark, folder, "text").select("doc_id", F.length("text").alias("n"), S.text_to_ids(F.lower("text")).alias("ids"))
    x = position(d, [], ["n", "doc_id"], "rk").withColumn("batch", F.expr("rk div 8"))
    p = B.pad_batch(x, "batch", ids="ids")
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    return p.select("doc_id", "batch", add("ids_mask").cast("int").alias("length"), F.size("ids_mask").alias("longest"), add("ids").alias("total"),
                    F.md5(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")).alias("padded"))


@query("batch_char_lanes", f"""
WITH l AS (SELECT conv_id, turn, role, i, v, row_number() OVER (ORDER BY conv_id, turn, role, i, md5(v)) - 1 AS ln, count(*) OVER () AS total FROM (
  SELECT conv_id, turn, role, i, s[i] AS v FROM (SELECT conv_id, turn, role, s, unnest(generate_series(1, len(s))) AS i FROM (SELECT conv_id, turn, role, string_split(text, '\n') AS s FROM conversations))))
, k AS (SELECT ln, ln // (total // 4) AS lane, v || '\n' AS v FROM l WHERE ln < total // 4 * 4),
f AS (SELECT *, coalesce(sum(len(v)) OVER (PARTITION BY lane ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM k),
c AS (SELECT lane, first + i AS place, instr({Q.lit(S.PRINTABLE)}, v[i + 1]) - 1 AS code FROM (SELECT *, unnest(range(0, len(v))) AS i FROM f))
SELECT (place // 50)::BIGINT AS batch, (place % 50)::INT AS step, lane::INT AS lane, code::INT AS char_id FROM c""")
def char_lanes(spark, folder):
    c = V.table(spark, folder, "conversations")
    lines = c.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("i", "value")).withColumn("h", F.md5(F.col("value").cast("binary")))
    return B.char_lanes(lines, ["conv_id", "turn", "role", "i", "h"], 4, 50)


@query("batch_fixed", """
SELECT vec_id, b::INT AS batch FROM (SELECT vec_id, b, row_number() OVER (PARTITION BY b ORDER BY md5('4:' || b || ':' || vec_id)) AS n FROM embeddings, (SELECT unnest(range(0, 2)) AS b) WHERE len(embedding) = 64) WHERE n <= 32""")
def fixed_batches(spark, folder):
    return B.fixed_batches(V.table(spark, folder, "embeddings"), ["vec_id"], 32, 4, 2, "leave", embedding=64).select("vec_id", "batch")


@query("batch_fixed_skip", skip_sql(8, 9, 200, "len(embedding) = 64"))
def fixed_skip_batches(spark, folder):
    e = V.table(spark, folder, "embeddings")
    return B.fixed_batches(e, ["vec_id"], 8, 9, 200, "leave", skip=True, embedding=64).select("vec_id", "batch")


# -- pronunciation and mixed representations --------------------------------------------------------------------------
# A small made-up lexicon: short words of the texts and their letters as phones.
LEXICON = {
    "the": ["DH", "AH0"], "and": ["AE1", "N", "D"], "of": ["AH1", "V"], "to": ["T", "UW1"], "a": ["AH0"], "in": ["IH0", "N"],
    "is": ["IH1", "Z"], "that": ["DH", "AE1", "T"], "for": ["F", "AO1", "R"], "with": ["W", "IH1", "DH"], "on": ["AA1", "N"],
    "as": ["AE1", "Z"], "it": ["IH1", "T"], "at": ["AE1", "T"], "no": ["N", "OW1"], "de": ["D", "IY1"], "la": ["L", "AA1"],
    "in-": ["IH0", "N"], "one": ["W", "AH1", "N"], "two": ["T", "UW1"], "mister": ["M", "IH1", "S", "T", "ER0"], "The": ["DH", "IY0"],
}
# A few made-up letter rules: one of each kind, then one per letter.
LETTERS = {
    "A": "AE", "B": "B", "C": "K", "D": "D", "E": "EH", "F": "F", "G": "G", "H": "HH", "I": "IH", "J": "JH", "K": "K", "L": "L", "M": "M",
    "N": "N", "O": "OW", "P": "P", "Q": "K", "R": "R", "S": "S", "T": "T", "U": "AH", "V": "V", "W": "W", "X": "K S", "Y": "IH", "Z": "Z",
    "-": "<->", "'": "",
}
RULES = [
    "[TH]=/TH/", "[CH]^=/K/", "[CH]=/CH/", "#[S]=/Z/", "[A]^%=/EY/", "[E]+:=/IY/", "[OU]=/AW/", "[QU]=/K W/", ":[Y]#=/Y/", "[ING]=/IH NG/",
    *[f"[{letter}]=/{phones}/" for letter, phones in LETTERS.items()],
]


def lexicon(spark):
    return spark.createDataFrame([(w, [p]) for w, p in LEXICON.items()], "word string, prons array<array<string>>")


def letter_rules(spark):
    lines = spark.createDataFrame(list(enumerate(RULES)), "line_no long, value string")
    return PH.parse_letter_rules(lines)


LEX = "lex AS (SELECT * FROM (VALUES " + ", ".join(
    f"({Q.lit(w)}, {Q.lit(''.join('@' + x.rstrip('012').lower() for x in p))})" for w, p in LEXICON.items()) + ") AS v(word, phones))"
WORDS = (
    "w AS (SELECT doc_id, u[3] AS idx, u[1] AS word, translate(u[1], '!?.,;:', '') AS bare, u[2] AS raw FROM (SELECT doc_id, "
    "unnest(list_zip(string_split(t, ' '), string_split(text, ' '), range(0, len(string_split(t, ' '))))) AS u FROM done) WHERE u[1] IS NOT NULL)"
)
LOOKED = f"{LEX}, x AS (SELECT w.*, coalesce(a.phones, b.phones) AS phones FROM w LEFT JOIN lex a ON a.word = w.raw LEFT JOIN lex b ON b.word = w.bare)"
PHONE_IDS = Q.ids_of(Q.phone_symbols("(phones || CASE WHEN instr('!?.,;:', word[-1]) > 0 AND word <> '' THEN word[-1] ELSE '' END)"), "phone")
CHUNKS = f"{LOOKED}, c AS (SELECT doc_id, idx, word, {Q.char_ids('word')} AS chars, CASE WHEN phones IS NULL THEN []::BIGINT[] ELSE ({PHONE_IDS})[:-2] END AS phones FROM x)"
RAW = "SELECT doc_id, text, text AS t FROM documents"


def corpus_words(spark, folder):
    d = V.documents(spark, folder, "text").withColumn("clean", T.english_cleaners(F.col("text")))
    return MX.text_words(d, "doc_id", "clean", "text")


@query("join_lookup_pronunciation", Q.chain(RAW, Q.ENGLISH, "") + f", {WORDS}, {LOOKED} SELECT doc_id, idx::INT AS idx, word, phones FROM x")
def lookup_pronunciation(spark, folder):
    x = PH.lookup_pronunciation(corpus_words(spark, folder), lexicon(spark), "raw_word", "bare")
    return x.select("doc_id", "idx", "word", "phones")


@query("filter_complete_phones", Q.chain(RAW, Q.ENGLISH, "") + f", {WORDS}, {LOOKED} SELECT doc_id || ':' || idx // 2 AS phrase FROM x GROUP BY ALL HAVING bool_and(phones IS NOT NULL)")
def complete_phones(spark, folder):
    phrase = F.concat_ws(":", F.col("doc_id").cast("string"), F.expr("idx div 2").cast("string"))
    x = PH.lookup_pronunciation(corpus_words(spark, folder), lexicon(spark), "raw_word", "bare").withColumn("phrase", phrase)
    return FL.complete_phones_filter(x, "phrase")


@query("mix_word_chunks", Q.chain(RAW, Q.ENGLISH, "") + f", {WORDS}, {CHUNKS} SELECT doc_id, idx::INT AS idx, {Q.csv('chars')} AS chars, {Q.csv('phones')} AS phones FROM c")
def word_chunks(spark, folder):
    c = MX.word_chunks(corpus_words(spark, folder), lexicon(spark), "doc_id")
    text = lambda n: F.array_join(F.col(n).cast("array<string>"), ",").alias(n)
    return c.select("doc_id", "idx", text("chars"), text("phones"))


def mixed_sql(mode, seed=11):
    flag = {
        "chars_only": "0", "phones_only": "1", "blended_pref": "CASE WHEN len(phones) > 0 THEN 1 ELSE 0 END", "blended": "fl[idx + 1]",
    }[mode]
    slots = (
        f"fl AS (SELECT doc_id, list_transform(list_sort(list_transform(range(0, 2 * n), lambda i: [md5('{seed}:' || doc_id || ':' || i), lpad(i::VARCHAR, 12, '0')])), "
        "lambda s: CASE WHEN s[2]::BIGINT >= n THEN 1 ELSE 0 END) AS fl FROM (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id))"
    )
    return (
        f", {WORDS}, {CHUNKS}, {slots}, f AS (SELECT doc_id, idx, chars, phones, {flag} AS flag FROM c JOIN fl USING (doc_id)), "
        "p AS (SELECT doc_id, idx, flag, CASE WHEN len(phones) = 0 OR flag = 0 THEN chars ELSE phones END AS part FROM f), "
        "q AS (SELECT doc_id, idx, CASE WHEN idx > 0 THEN [35]::BIGINT[] ELSE []::BIGINT[] END || part AS part, CASE WHEN idx > 0 THEN [0] ELSE [] END || list_transform(part, lambda v: flag) AS mask FROM p), "
        "m AS (SELECT doc_id, flatten(list(part ORDER BY idx)) || [1] AS ids, flatten(list(mask ORDER BY idx)) || [" + ("1" if mode == "phones_only" else "0") + "] AS mask FROM q GROUP BY doc_id) "
    )


def mixed(name, mode):
    @query(name, Q.chain(RAW, Q.ENGLISH, "") + mixed_sql(mode) + f"SELECT doc_id, {Q.csv('ids')} AS ids, array_to_string(mask, '') AS mask FROM m")
    def run(spark, folder):
        c = MX.word_chunks(corpus_words(spark, folder), lexicon(spark), "doc_id")
        m = MX.mix_representations(c, "doc_id", mode, 11)
        return m.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.array_join(F.col("mask").cast("array<string>"), "").alias("mask"))


for _mode in ("chars_only", "phones_only", "blended_pref", "blended"):
    mixed(f"mix_{_mode}", _mode)


@query("mix_both", Q.chain(RAW, Q.ENGLISH, "") + f""", {WORDS}, {CHUNKS} SELECT doc_id, {Q.csv("flatten(list(CASE WHEN idx > 0 THEN [35]::BIGINT[] ELSE []::BIGINT[] END || chars ORDER BY idx))")} AS ids,
{Q.csv("flatten(list(CASE WHEN idx > 0 THEN [41]::BIGINT[] ELSE []::BIGINT[] END || phones ORDER BY idx))")} AS phone_ids FROM c GROUP BY doc_id""")
def mix_both(spark, folder):
    m = MX.mix_representations(MX.word_chunks(corpus_words(spark, folder), lexicon(spark), "doc_id"), "doc_id", "both")
    text = lambda n: F.array_join(F.col(n).cast("array<string>"), ",").alias(n)
    return m.select("doc_id", text("ids"), text("phone_ids"))


SHOWN = {k: Q.words([s if k == "char" or s in "_~ !,:?" else "@" + s for s in S.VOCABULARY[k]]) for k in ("char", "phone")}


@query("mix_unmix", Q.chain(RAW, Q.ENGLISH, "") + mixed_sql("blended_pref")
       + f"SELECT doc_id, array_to_string(list_transform(list_zip(ids, mask), lambda z: CASE WHEN z[2] = 1 THEN {SHOWN['phone']}[z[1] + 1] ELSE {SHOWN['char']}[z[1] + 1] END), '') AS text FROM m")
def unmix(spark, folder):
    m = MX.mix_representations(MX.word_chunks(corpus_words(spark, folder), lexicon(spark), "doc_id"), "doc_id", "blended_pref")
    return m.select("doc_id", S.unmix(F.col("ids"), F.col("mask")).alias("text"))


PATTERNS = [".ab1o", "1ti", "2io", "e1r", "n1d", "4s.", "a1b", "1ca", "o2n", "en3t", "1la", "i1e", "r1t", "2st1r", "u1n"]


@query("phones_hyphenate", f"""
WITH pat AS (SELECT unnest({Q.words(PATTERNS)}) AS p), pp AS (SELECT regexp_replace(p, '[0-9]', '', 'g') AS letters, string_split(regexp_replace(p, '[.a-z]', '|', 'g'), '|') AS slots FROM pat),
pt AS (SELECT letters, i - 1 AS off, slots[i]::INT AS value FROM (SELECT *, unnest(generate_series(1, len(slots))) AS i FROM pp) WHERE slots[i] <> ''),
wd AS MATERIALIZED (SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) AS w FROM documents) WHERE w <> ''),
hit AS (SELECT wd.word, s - 1 + off AS p, max(value) AS v FROM (SELECT word, unnest(generate_series(1, len(word) + 2)) AS s FROM wd WHERE len(word) > 4) wd JOIN pt ON substr('.' || word || '.', s, len(letters)) = letters GROUP BY ALL),
br AS (SELECT word, list_sort(list(p - 1)) AS cuts FROM hit WHERE v % 2 = 1 AND p > 2 AND p <= len(word) - 1 GROUP BY word),
ct AS (SELECT word, [0] || coalesce(cuts, []) || [len(word)] AS k FROM wd LEFT JOIN br USING (word))
SELECT word, array_to_string(list_transform(range(1, len(k)), lambda i: substr(word, (k[i] + 1)::INT, (k[i + 1] - k[i])::INT)), '-') AS pieces FROM ct""")
def hyphenate(spark, folder):
    w = V.documents(spark, folder, "text").select(F.explode(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " ")).alias("word")).where("word <> ''")
    pats = PH.parse_hyphen_patterns(spark.createDataFrame([(p,) for p in PATTERNS], "pattern string"))
    return PH.hyphenate(w, pats).select("word", F.array_join("pieces", "-").alias("pieces"))
