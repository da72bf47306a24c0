"""Further registered queries: votes and means, positions, flattening, configurations, crops, groups, levels, trials, sinks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import ids, text
from tessera.operators import collection, graph, knn, metrics, regions, tiles
from tessera.plans import fixtures as fx
from tessera.plans.catalogue import _LOGITS, _RECT, _WORDS, ASKED, COS, L2SQ, H, I, P, R, _logits, _scratch, query
from tessera.session import read
from tessera.sources import files

BYTE_PAIRS = "word_bpe_49k.json"


@query(f"SELECT query_id, n_label AS vote FROM (SELECT query_id, n_label, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(rank)) AS r FROM ({R}) WHERE rank <= 5 GROUP BY query_id, n_label) WHERE r = 1")
def legacy_vote(spark, d):
    return metrics.legacy_vote(fx.ranked_patients(spark, d).filter("rank <= 5"), "n_label")


@query("SELECT round(avg(a), 6) AS c_acctbal, round(avg(b), 6) AS c_custkey FROM (SELECT c_nationkey, avg(c_acctbal) AS a, avg(c_custkey) AS b FROM customer GROUP BY c_nationkey)")
def mean_of_groups(spark, d):
    m = metrics.mean_of_groups(read(spark, d, "customer"), "c_nationkey", "c_acctbal", "c_custkey")
    return m.select(F.round("c_acctbal", 6).alias("c_acctbal"), F.round("c_custkey", 6).alias("c_custkey"))


@query("""SELECT label, how, round(embedding[1]::DOUBLE, 6) AS x FROM (SELECT label, embedding, unnest(list_filter(['first', 'last', 'argmax'],
 lambda h: (h = 'first' AND f = 1) OR (h = 'last' AND l = 1) OR (h = 'argmax' AND a = 1))) AS how FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS f, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS l,
 row_number() OVER (PARTITION BY label ORDER BY vec_id % 17 DESC, vec_id) AS a FROM embeddings))""")
def pooled_tokens(spark, d):
    e = fx.embeddings(spark, d).withColumn("k", F.col("vec_id") % 17)
    out = None
    for how in ("first", "last", "argmax"):
        one = metrics.pooled_tokens(e, "label", "vec_id", "embedding", how, "k").select("label", F.lit(how).alias("how"), F.round(F.element_at("pooled", 1).cast("double"), 6).alias("x"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT folder, count(*) AS n FROM (SELECT regexp_replace(url, '/[^/]*$', '') AS folder FROM pages) GROUP BY folder")
def tile_histogram(spark, d):
    return files.tile_histogram(read(spark, d, "pages").select(F.regexp_replace("url", "/[^/]*$", "").alias("folder")))


@query("SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, '|')) AS digest FROM (SELECT doc_id, flatten(list_transform(string_split(text, chr(10)), lambda l: string_split(l, ' '))) AS t FROM documents WHERE text IS NOT NULL)")
def flattened_lists(spark, d):
    t = F.flatten(F.transform(F.split("text", "\n"), lambda line: F.split(line, " ")))
    return read(spark, d, "documents").filter("text is not null").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, "|")).alias("digest"))


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, n.vec_id AS neighbor_id, {L2SQ} AS score FROM ({ASKED}) q, embeddings n)
 SELECT query_id, rank, info FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, CAST(floor(neighbor_id / 4) AS BIGINT), neighbor_id % 4) AS rank FROM s) h JOIN ({I}) i ON i.vec_id = h.neighbor_id WHERE rank <= 6 AND neighbor_id < 300""")
def positional_join(spark, d):
    infos = fx.infos(spark, d).filter("vec_id < 300").select((F.col("vec_id") % 4).alias("shard_id"), F.floor(F.col("vec_id") / 4).alias("local_idx"), "info")
    return knn.positional(knn.sharded(fx.embeddings(spark, d), fx.asked(spark, d), 6), infos).select("query_id", "rank", "info")


@query("""WITH a AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS position FROM customer), b AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS position FROM supplier)
 SELECT c_nationkey AS nation, a.position, c_custkey AS customer, s_suppkey AS supplier FROM a JOIN b ON s_nationkey = c_nationkey AND a.position = b.position""")
def positional_zip(spark, d):
    w = lambda k, v: F.row_number().over(Window.partitionBy(k).orderBy(v)).cast("long")
    side = lambda t, k, v: read(spark, d, t).select(F.col(k).alias("nation"), w(k, v).alias("position"), F.col(v).alias("value"))
    return knn.zipped("nation", customer=side("customer", "c_nationkey", "c_custkey"), supplier=side("supplier", "s_nationkey", "s_suppkey"))


@query(f"""SELECT query_id, neighbor_id, row_number() OVER (ORDER BY score DESC, query_id, neighbor_id) AS position FROM ({H})""")
def pooled_hits(spark, d):
    return knn.pooled(fx.hits(spark, d).select("query_id", "neighbor_id", "score")).select("query_id", "neighbor_id", "position")


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 1200000")
def sub_dataset(spark, d):
    return collection.scrolled(fx.embeddings(spark, d).select("vec_id", "label"), "vec_id", 1_200_000)


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN '0' ELSE CAST(n_regionkey AS VARCHAR) END AS mean, n_name AS mode, 'bicubic' AS interpolation FROM nation")
def merged_config(spark, d):
    base = F.create_map(F.lit("mean"), F.lit("0"), F.lit("mode"), F.lit("RGB"), F.lit("interpolation"), F.lit("bicubic"))
    over = F.create_map(F.lit("mean"), F.when(F.col("n_regionkey") != 1, F.col("n_regionkey").cast("string")), F.lit("mode"), F.col("n_name"), F.lit("unknown"), F.lit("x"))
    m = ids.merged_config(base, over)
    return read(spark, d, "nation").select("n_nationkey", *[m[k].alias(k) for k in ("mean", "mode", "interpolation")])


@query("SELECT p_partkey, replace(lower(p_name || '-' || p_brand), '-', '_') AS tag FROM part")
def clean_tags(spark, d):
    return read(spark, d, "part").select("p_partkey", ids.clean_tag(F.concat_ws("-", "p_name", "p_brand")).alias("tag"))


@query("SELECT page_id, contains(url, 'http') AS remote FROM pages")
def remote_paths(spark, d):
    return read(spark, d, "pages").select("page_id", ids.is_remote(F.col("url")).alias("remote"))


@query(f"""WITH l AS (SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY batch, i) AS p FROM (SELECT *, row_number() OVER (PARTITION BY batch, i ORDER BY logit DESC, j) AS r FROM ({_LOGITS})) WHERE r <= 8),
 c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY batch, i ORDER BY logit DESC, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM l)
 SELECT batch, i, j, round(p / sum(p) OVER (PARTITION BY batch, i), 6) AS p FROM c WHERE b < 0.9""")
def filtered_logits(spark, d):
    return metrics.filtered_logits(_logits(spark, d), ("batch", "i"), 8, 0.9).select("batch", "i", "j", F.round("p", 6).alias("p"))


@query(f"""WITH r AS ({_RECT}), e AS (SELECT a.patch_id AS src, b.patch_id AS dst FROM r a JOIN r b ON a.slide_no = b.slide_no AND a.patch_id <> b.patch_id WHERE ((a.x + a.w = b.x OR b.x + b.w = a.x) AND a.y < b.y + b.h AND b.y < a.y + a.h) OR ((a.y + a.h = b.y OR b.y + b.h = a.y) AND a.x < b.x + b.w AND b.x < a.x + a.w)),
 c AS (WITH RECURSIVE c(node, other) AS (SELECT patch_id, patch_id FROM r UNION SELECT c.node, e.dst FROM c JOIN e ON e.src = c.other) SELECT * FROM c)
 SELECT node AS patch_id, min(other) AS region_id FROM c GROUP BY node""")
def touching_groups(spark, d):
    r = fx.patches(spark, d).filter("level = 1 AND is_foreground = 1").select(F.col("vec_id").alias("patch_id"), "slide_no", (F.col("gx") * 10).alias("x"), (F.col("gy") * 10).alias("y"), F.when(F.col("vec_id") % 6 == 0, 20).otherwise(10).alias("w"), F.lit(10).alias("h"))
    return regions.touching_groups(r, ["slide_no"]).select("patch_id", "region_id")


@query(f"""SELECT slide_no, concat(slide_no, '_S', slide_no) AS label, concat('http://tiles/S', slide_no, '/', min(gx) * 256, '/', min(gy) * 256, '/', (max(gx) - min(gx) + 1) * 256, '/', (max(gy) - min(gy) + 1) * 256, '/1') AS url
 FROM ({P}) WHERE level = 1 AND is_foreground = 1 GROUP BY slide_no""")
def region_urls(spark, d):
    p = fx.patches(spark, d).filter("level = 1 AND is_foreground = 1").withColumn("region_id", F.col("slide_no")).withColumn("score", F.lit(1.0))
    boxes = regions.region_boxes(p, ["slide_no"]).withColumn("name", F.concat(F.lit("S"), "slide_no")).withColumn("level", F.lit(1))
    return regions.region_urls(boxes, "http://tiles", "slide_no", "name").select("slide_no", "label", "url")


@query(f"""WITH q AS (SELECT CAST(floor(vec_id / 100) AS BIGINT) AS image, CAST((vec_id % 100) / 20 AS BIGINT) AS i, embedding, vec_id FROM ({ASKED})),
 h AS (SELECT image, q.vec_id, CAST(floor(i // 3) AS BIGINT) AS tile_row, i % 3 AS tile_column, n.slide_no, round({COS}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, n.vec_id) AS rank FROM q, ({P}) n)
 SELECT image, tile_row, tile_column, slide_no, round(sum(score), 6) AS total, count(*) AS n FROM h WHERE rank <= 20 GROUP BY ALL""")
def batched_region_query(spark, d):
    p = fx.patches(spark, d)
    asked = fx.asked(spark, d)
    hits = knn.knn(p, asked, 20).withColumn("score", F.round("score", 6)).join(p.select(F.col("vec_id").alias("neighbor_id"), "slide_no"), "neighbor_id")
    placed = asked.select(F.col("vec_id").alias("query_id"), F.floor(F.col("vec_id") / 100).alias("image"), ((F.col("vec_id") % 100) / 20).cast("long").alias("i"))
    placed = regions.tile_positions(placed, "i", 3).withColumnRenamed("row", "tile_row").withColumnRenamed("column", "tile_column")
    return hits.join(placed, "query_id").groupBy("image", "tile_row", "tile_column", "slide_no").agg(F.round(F.sum("score"), 6).alias("total"), F.count("*").alias("n"))


@query(f"SELECT vec_id AS node, slide_no AS wsi_id, level, gx, gy FROM ({P}) WHERE level = 0 OR is_foreground = 1")
def added_levels(spark, d):
    p = fx.patches(spark, d).select(F.col("vec_id").alias("node"), F.col("slide_no").alias("wsi_id"), "level", "gx", "gy", "embedding", "is_foreground")
    coarse = graph.add_level(None, p.filter("level = 0"), 0)
    return graph.add_level(coarse, p.filter("level = 1"), 1, F.col("is_foreground") == 1).drop("embedding")


_DRAW = "(('0x' || substr(md5(concat_ws(':', s, level, t, '{0}', 0)), 1, 8))::BIGINT % ({1} - side + 1))"


@query(f"""WITH s AS (SELECT DISTINCT slide_no AS s FROM ({P})), l AS (SELECT s, unnest([0, 1]) AS level FROM s), t AS (SELECT *, CASE WHEN level = 1 THEN 448 ELSE 1120 END AS side, 1280 * (level + 1) AS w, 1120 * (level + 1) AS h FROM l, (SELECT unnest(range(0, 100)) AS t)),
 x AS (SELECT s AS slide_no, level, t AS try, {_DRAW.format("x", "w")} AS x, {_DRAW.format("y", "h")} AS y, side FROM t)
 SELECT slide_no, level, try, x, y, side FROM (SELECT *, row_number() OVER (PARTITION BY slide_no, level ORDER BY try) AS n FROM x WHERE (x + y) % 5 <> 0) WHERE n <= 3""")
def sampled_crops(spark, d):
    one = fx.patches(spark, d).select("slide_no").distinct().withColumn("level", F.explode(F.array(F.lit(0), F.lit(1))))
    levels = one.withColumn("width", 1280 * (F.col("level") + 1)).withColumn("height", 1120 * (F.col("level") + 1)).withColumn("is_last", F.col("level") == 1)
    return tiles.sampled_crops(levels, lambda t: t.filter((F.col("x") + F.col("y")) % 5 != 0), ["slide_no", "level"]).withColumn("try", F.col("try").cast("long"))


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS t FROM documents), e AS (SELECT doc_id, len(t) AS n, i, t[i] AS word, row_number() OVER (PARTITION BY doc_id ORDER BY md5(concat(doc_id, ':', i - 1))) AS r FROM w, LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i))
 SELECT doc_id, md5(string_agg(word, ' ' ORDER BY i)) AS digest FROM e WHERE r <= greatest(1, floor(n * 0.75)) GROUP BY doc_id""")
def dropped_tokens(spark, d):
    t = text.dropped(text.words(F.col("text")), F.col("doc_id"), 0.25)
    return read(spark, d, "documents").select("doc_id", F.array_join(t, " ").alias("kept")).filter("kept <> ''").select("doc_id", F.md5("kept").alias("digest"))


@query("WITH c AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events)) SELECT event_id, e.event_type AS label, code FROM events e JOIN c ON c.event_type = e.event_type")
def decoded_labels(spark, d):
    e = read(spark, d, "events").select("event_id", "event_type")
    coded = e.select(F.col("event_type").alias("label")).distinct()
    codes = knn.numbered_rows(coded, "label").withColumnRenamed("_row", "code")
    encoded = e.join(codes.withColumnRenamed("label", "event_type"), "event_type").select("event_id", "code")
    return metrics.decoded(encoded, codes, "code", "label")


@query("SELECT vec_id % 10 AS label2, count(*) AS n FROM embeddings GROUP BY ALL")
def csv_round_trip(spark, d):
    path = _scratch(spark, "csv")
    files.write_csv(fx.embeddings(spark, d).groupBy((F.col("vec_id") % 10).alias("label2")).agg(F.count("*").alias("n")), path)
    return files.read_csv(spark, path, "label2 long, n long")


@query("SELECT label, count(*) AS n, round(sum(embedding[1]::DOUBLE), 4) AS s FROM embeddings GROUP BY label")
def json_round_trip(spark, d):
    path = _scratch(spark, "json")
    files.write_json(fx.embeddings(spark, d), path, "label")
    back = spark.read.schema("vec_id long, embedding array<float>, label int").json(path)
    return back.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.element_at("embedding", 1).cast("double")), 4).alias("s"))


@query("SELECT count(*) AS n, round(sum(embedding[1]::DOUBLE), 4) AS s FROM embeddings")
def matrix_round_trip(spark, d):
    path = _scratch(spark, "npy").removeprefix("file://")
    told = files.write_matrices(fx.embeddings(spark, d), path, "vec_id")
    if not told.agg(F.sum("rows")).first()[0]:
        return spark.createDataFrame([], "n long, s double")
    return files.matrices(spark, path).agg(F.count("*").alias("n"), F.round(F.sum(F.element_at("embedding", 1).cast("double")), 4).alias("s"))


@query(f"""WITH n AS (SELECT vec_id AS node, level, row_number() OVER (PARTITION BY level ORDER BY md5(concat(vec_id, ':', 0)), vec_id) AS r FROM ({P})) SELECT node, level FROM n WHERE r <= 1000""")
def sampled_index(spark, d):
    n = fx.patches(spark, d).select(F.col("vec_id").alias("node"), "level")
    edges = n.select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst"))
    return files.sampled_index(n, edges)[0]


@query("SELECT CAST(count(*) AS BIGINT) AS n, min(id) AS least, max(id) AS most, count(extra) AS extras FROM (SELECT vec_id AS id, NULL::INT AS extra FROM embeddings UNION ALL SELECT (SELECT max(vec_id) FROM embeddings) + row_number() OVER (ORDER BY vec_id), 1 FROM embeddings WHERE label = 3)")
def inserted_rows(spark, d):
    c = collection.Collection(spark, _scratch(spark, "inserts"), "vectors")
    c.create(64, "cosine", "label int")
    e = fx.embeddings(spark, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    c.upsert(e)
    c.insert(e.filter("label = 3").drop("id").withColumn("extra", F.lit(1)))
    return c.rows().agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most"), F.count("extra").alias("extras"))


@query()
def byte_pair_tokens(spark, d):
    """Rows only: the vocabulary's merges are not SQL. Fixed-length ids of every text, and what they read as."""
    path = public_tokenizers.path(BYTE_PAIRS)
    rows = read(spark, d, "documents").select("doc_id", text.byte_pair_ids(F.col("text"), path).alias("ids"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), text.fixed_length(F.col("ids")).alias("ids"), text.byte_pair_text(F.col("ids"), path).alias("text"))


@query()
def region_trials(spark, d):
    """Rows only: trials are drawn by hash. Sizes, queries and rounds as in region evaluation; a trial succeeds if its slide comes first."""
    p = fx.patches(spark, d).filter("level = 1")
    windows = None
    for w, h in ((2, 2), (4, 2), (4, 4)):
        one = regions.full_windows(p, ["slide_no"], w, h).withColumn("w", F.lit(w)).withColumn("h", F.lit(h))
        windows = one if windows is None else windows.unionByName(one)
    windows = windows.toDF(*[{"gx": "x0", "gy": "y0", "x": "x0", "y": "y0"}.get(c, c) for c in windows.columns]).select("slide_no", "x0", "y0", "w", "h")
    drawn = regions.trials(windows, ((2, 2), (4, 2), (4, 4)))
    trial = F.xxhash64("size", "round", "query").alias("vec_id")
    cell = drawn.select(trial, "slide_no", F.explode(F.sequence(F.col("x0"), F.col("x0") + F.col("w") - 1)).alias("gx"), "y0", "h").select("vec_id", "slide_no", "gx", F.explode(F.sequence(F.col("y0"), F.col("y0") + F.col("h") - 1)).alias("gy"))
    members = cell.join(p.select("slide_no", "gx", "gy", "embedding"), ["slide_no", "gx", "gy"])
    asked = metrics.pooled(members, "vec_id", "embedding").withColumnRenamed("pooled", "embedding")
    hits = knn.knn(p, asked, 10).join(p.select(F.col("vec_id").alias("neighbor_id"), "slide_no"), "neighbor_id")
    best = regions.best_slide(hits, "slide_no").withColumnRenamed("slide_no", "found").withColumnRenamed("query_id", "vec_id")
    scored = drawn.withColumn("vec_id", F.xxhash64("size", "round", "query")).join(best, "vec_id").withColumn("right", (F.col("found") == F.col("slide_no")).cast("double"))
    return regions.trial_report(scored, "right")
