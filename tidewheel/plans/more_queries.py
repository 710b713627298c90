"""Registered queries of functions that the others leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import offers as O
from ..functions import signals as S
from ..functions import text as X
from ..operators import dispatch, extract, report, search, state
from ..sources import feeds
from . import tables as T
from .queries import _re2, query


@query("SELECT id, CASE category WHEN '1-URGENT' THEN 'urgent-room' WHEN '2-HIGH' THEN 'high-room' ELSE 'general' END AS route FROM offers")
def routed_offers(spark, sf_dir):
    """The channel of each offer's category; a blank or missing one gives the default."""
    rows = T.offers(spark, sf_dir)
    c = F.col("category")
    routes = rows.select("category").distinct().filter("category <> '5-LOW'").withColumn("route", F.when(c == "1-URGENT", "urgent-room").when(c == "2-HIGH", " high-room ").when(c == "3-MEDIUM", "  "))
    return dispatch.route(rows.select("id", "category"), routes, default="general").select("id", "route")


@query("SELECT a.vec_id AS id, CASE WHEN a.vec_id % 5 = 0 THEN 0.0 ELSE round(list_cosine_similarity(CAST(a.embedding AS double[]), CAST(b.embedding AS double[])), 6) END AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_cosines(spark, sf_dir):
    """Each vector and the next id's; every fifth is cut, and vectors of unequal lengths have 0."""
    v = T.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    cut = F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 7)).otherwise(F.col("embedding"))
    a, b = v.select(F.col("vec_id").alias("id"), cut.alias("a")), v.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("b"))
    return a.join(b, "id").select("id", F.round(O.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query("SELECT string_agg(CASE WHEN length(k) < 15 THEN rpad(k, 15, ' ') ELSE k END || ' — brand of ' || n || ' parts', chr(10) ORDER BY k) AS block, string_agg(k, ', ' ORDER BY k) AS keys FROM (SELECT lower(p_brand) || CASE WHEN p_brand LIKE '%5' THEN '-of-the-house' ELSE '' END AS k, count(*) AS n FROM part GROUP BY 1)")
def prompt_categories(spark, sf_dir):
    """A taxonomy of brands as lines of a prompt and as a list of keys."""
    key = F.concat(F.lower("p_brand"), F.when(F.col("p_brand").endswith("5"), "-of-the-house").otherwise(""))
    brands = T.table(spark, sf_dir, "part").groupBy(key.alias("key")).agg(F.concat(F.lit("brand of "), F.count("*").cast("string"), F.lit(" parts")).alias("description")).withColumn("position", F.col("key"))
    return O.category_prompt_block(brands).crossJoin(O.category_prompt_csv(brands))  # two results of one row each


@query("SELECT p_partkey, printf('#%06X', CAST(p_partkey * 4099 % 16777216 AS bigint)) AS color FROM part")
def hex_colors(spark, sf_dir):
    return T.table(spark, sf_dir, "part").select("p_partkey", O.hex_color(F.col("p_partkey") * 4099 % 16777216).alias("color"))


@query(f"SELECT doc_id, unnest(l) AS repo, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, '') || ' at https://github.com/login/x, http://github.com/o' || doc_id % 50 || '/r.' || doc_id || ') https://github.com/explorer/y', '{_re2(V.GITHUB_REPO)}'), lambda u: NOT regexp_matches(u, 'github[.]com/(login|signup|explore|topics|trending|features|marketplace|pricing)')) AS l FROM documents)")
def mentioned_repos(spark, sf_dir):
    """Repositories in whole texts with a mention added; pages of the site itself are none."""
    d = F.col("doc_id")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" at https://github.com/login/x, http://github.com/o"), (d % 50).cast("string"), F.lit("/r."), d.cast("string"), F.lit(") https://github.com/explorer/y"))
    return T.spread(T.table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(S.extract_github_repos(text)).alias("pos", "repo")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT 'all' AS held, EXISTS (SELECT 1 FROM sendable s WHERE NOT EXISTS (SELECT 1 FROM dispatches d WHERE d.offer_id = s.id AND d.status = 'sent')) AS waiting UNION ALL SELECT 'none left', EXISTS (SELECT 1 FROM sendable s WHERE s.category NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') AND NOT EXISTS (SELECT 1 FROM dispatches d WHERE d.offer_id = s.id AND d.status = 'sent'))")
def waiting_offers(spark, sf_dir):
    """Whether any offer waits, and whether one does when all categories are held."""
    o, d = T.offers(spark, sf_dir), T.dispatches(spark, sf_dir)
    every = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    rows = [("all", dispatch.has_undispatched(o, d, channel="discord")), ("none left", dispatch.has_undispatched(o, d, channel="discord", held=every))]
    return spark.createDataFrame(rows, "held string, waiting boolean")


@query("SELECT p_brand AS tag, p_name AS query FROM part WHERE p_brand IN ('Brand#2', 'Brand#17')")
def lane_templates(spark, sf_dir):
    """Query templates of one lane; a gated tag is left out."""
    templates = T.table(spark, sf_dir, "part").select(F.col("p_brand").alias("tag"), F.col("p_name").alias("query"))
    tags = F.when(F.col("r_name") == "ASIA", F.array(F.lit("Brand#2"), F.lit("Brand#17"), F.lit("Brand#5"))).otherwise(F.array().cast("array<string>"))
    lanes = T.table(spark, sf_dir, "region").select(F.col("r_name").alias("lane"), tags.alias("tags"))
    return feeds.select_templates(templates, lanes, lane="ASIA", gated=["Brand#5"])


@query("(SELECT n_name AS key, 'left' AS side FROM nation WHERE n_nationkey % 2 = 0 EXCEPT SELECT n_name, 'left' FROM nation WHERE n_nationkey % 3 = 0) UNION ALL (SELECT n_name, 'right' FROM nation WHERE n_nationkey % 3 = 0 EXCEPT SELECT n_name, 'right' FROM nation WHERE n_nationkey % 2 = 0)")
def taxonomy_differences(spark, sf_dir):
    keys = T.table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), "n_nationkey")
    return O.taxonomy_differences(keys.filter("n_nationkey % 2 = 0"), keys.filter("n_nationkey % 3 = 0"))


@query("""SELECT r.id AS raw_item_id, x.name AS source_name, r.id || '' AS external_id, 'Get ' || CASE WHEN r.id < 10 THEN '*' || r.id || '*' ELSE r.id || '' END || ' for free at http://in.io/' || r.id || ' now' AS text, 'http://in.io/' || r.id || ' http://out.io/' || r.id AS urls, CASE WHEN r.id % 2 = 0 THEN 'h' || r.id ELSE '' END AS author_handle, CASE WHEN r.id % 2 = 0 THEN '{"likes":3}' ELSE '{}' END AS engagement
FROM raw_items r JOIN sources x ON x.id = r.source_id""")
def normalized_items(spark, sf_dir):
    """Payloads with markup, doubled marks and odd spaces as clean items; URLs of the text come before the payload's."""
    i = F.col("id").cast("string")
    text = F.concat(F.lit("Get   **"), i, F.lit("** for free   at http://in.io/"), i, F.lit("  now "))
    even = F.col("id") % 2 == 0
    payload = F.to_json(F.struct(text.alias("text"), F.array(F.concat(F.lit("http://out.io/"), i)).alias("urls"), F.when(even, F.concat(F.lit("h"), i)).alias("author_handle"), F.when(even, '{"likes":3}').alias("engagement")))
    raw = T.raw_items(spark, sf_dir).withColumn("raw_payload", payload)
    done = extract.normalize_items(raw, T.sources(spark, sf_dir).withColumn("kind", F.lit("api")))
    return done.select("raw_item_id", "source_name", "external_id", "text", F.array_join("urls", " ").alias("urls"), "author_handle", "engagement")


@query("""SELECT id, CASE WHEN s < 0 THEN 'expired ' || d || 'd ago' WHEN d = 1 THEN 'in 1 day' ELSE 'in ' || d || ' days' END AS expires, CASE WHEN s < 0 THEN 'expired' WHEN d <= 3 THEN 'soon' ELSE 'ok' END AS state, CASE WHEN ago < 60 THEN ago || 's ago' WHEN ago < 3600 THEN ago // 60 || 'm ago' WHEN ago < 86400 THEN ago // 3600 || 'h ago' ELSE ago // 86400 || 'd ago' END AS seen
FROM (SELECT id, s, CAST(ceil(abs(s) / 86400) AS bigint) AS d, greatest(0, CAST(floor(-f) AS bigint)) AS ago FROM (SELECT id, epoch(expires_at - TIMESTAMP '1998-08-02') AS s, epoch(first_seen - TIMESTAMP '1998-08-02') AS f FROM offers))""")
def time_labels(spark, sf_dir):
    rows = T.offers(spark, sf_dir).withColumn("e", X.expires_in(F.col("expires_at"), T.as_of()))
    return rows.select("id", F.col("e.label").alias("expires"), F.col("e.state").alias("state"), X.time_ago(F.col("first_seen"), T.as_of()).alias("seen"))


@query("SELECT id, status, CAST(row_number() OVER (PARTITION BY status ORDER BY id DESC) AS int) AS place FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' WHEN c_custkey % 3 = 1 THEN 'approved' ELSE 'rejected' END AS status FROM customer) QUALIFY place <= 40 AND status = 'new'")
def newest_channels(spark, sf_dir):
    """The 40 newest channels of a status (a top-k list)."""
    k = F.col("c_custkey")
    rows = T.table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 3 == 0, "new").when(k % 3 == 1, "approved").otherwise("rejected").alias("status"))
    top = state.list_channels(rows, "new", limit=40)
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.partitionBy("status").orderBy(F.desc("id"))))


@query("""SELECT category, count(*) AS n, true AS median_holds, true AS p90_holds, true AS handles_hold FROM offers o JOIN dispatches d ON d.offer_id = o.id WHERE status = 'sent' AND CAST(sent_at AS date) BETWEEN DATE '1995-01-01' AND DATE '1997-06-30' GROUP BY category""")
def sketched_latency(spark, sf_dir):
    """Counts of a range of days from stored sketches, and whether their quantiles (rank within 3 %) and distinct handles (within 5 %) hold against the exact ones."""
    o, d = T.offers(spark, sf_dir), T.dispatches(spark, sf_dir)
    first, last = F.lit("1995-01-01").cast("date"), F.lit("1997-06-30").cast("date")
    stored = state.written(report.daily_sketches(o, d), "daily_sketches")
    got = report.from_sketches(stored, first=first, last=last)
    sent = d.filter("status = 'sent'").select(F.col("offer_id").alias("id"), "sent_at").filter(F.to_date("sent_at").between(first, last))
    h = (F.col("sent_at").cast("double") - F.col("first_seen").cast("double")) / 3600
    rows = o.join(sent, "id").select("category", h.alias("h"), "author_handle")
    ranks = rows.join(got.select("category", "median_h", "p90_h"), "category").groupBy("category").agg(*[(F.count_if(F.col("h") < F.col(c)) / F.count("*")).alias(f"{c}_low") for c in ("median_h", "p90_h")], *[(F.count_if(F.col("h") <= F.col(c)) / F.count("*")).alias(f"{c}_high") for c in ("median_h", "p90_h")], F.count_distinct("author_handle").alias("distinct"))
    holds = lambda c, q: (F.col(f"{c}_low") <= q + 0.03) & (F.col(f"{c}_high") >= q - 0.03)
    return got.join(ranks, "category").select("category", "n", holds("median_h", 0.5).alias("median_holds"), holds("p90_h", 0.9).alias("p90_holds"), (F.abs(F.col("handles") - F.col("distinct")) <= 0.05 * F.col("distinct")).alias("handles_hold"))


@query("SELECT p_partkey AS id, title FROM (SELECT p_partkey, p_name || ' ' || p_brand || ' no. ' || p_partkey AS title FROM part) WHERE contains(lower(title), 'brand#1')")
def title_search(spark, sf_dir):
    """Titles that hold some words, by a stored trigram table."""
    title = F.concat_ws(" ", "p_name", "p_brand", F.lit("no."), F.col("p_partkey").cast("string"))
    rows = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), title.alias("title"))
    postings = state.written(search.trigram_postings(rows), "trigrams")
    return search.search_titles(rows, postings, "Brand#1")
