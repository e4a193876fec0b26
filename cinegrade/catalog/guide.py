"""Page, guide and weak-label queries, and rating reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinegrade.catalog import tables as T
from cinegrade.fixed_values import ALL_RATINGS, DENIALS, GUIDE_CATEGORIES
from cinegrade.functions import html as H
from cinegrade.functions import labels as L
from cinegrade.functions import text as X
from cinegrade.operators.terms import grouped_key_words
from cinegrade.plans import guide as G
from cinegrade.plans import reasons as R
from cinegrade.session import cut_lineage, scratch_path
from cinegrade.sources import readers, writers
from cinegrade.streaming import ingest
from cinegrade.streaming.score import arriving

SECTIONS = list(GUIDE_CATEGORIES)

DIMENSIONS = [name.lower() for name in GUIDE_CATEGORIES.values()]
N_KEY_WORDS = 12


def guide_find(spark, d):
    found = readers.find_guides(T.guides(spark, d), SECTIONS)
    return found.select("imdb_id", *[F.array_join(c, "|").alias(c) for c in SECTIONS])


def unpivot_sections(spark, d):
    long = G.unpivot_sections(T.guides(spark, d), SECTIONS)
    return long.select("imdb_id", "category", F.array_join("sentences", "|").alias("sentences"))


def guide_tokens(spark, d):
    long = G.unpivot_sections(T.guides(spark, d), SECTIONS)
    tokens = X.comment_tokens(F.col("sentences"))
    return long.select("imdb_id", "category", F.array_join(tokens, " ").alias("comment"))


def _comments(spark, d):
    return G.comment_table(T.guides(spark, d))


def rename_categories(spark, d):
    long = G.unpivot_sections(T.guides(spark, d), SECTIONS)
    return G.rename_categories(long).select("imdb_id", "category")


def n_words(spark, d):
    return _comments(spark, d).select("imdb_id", "category", F.col("n_words").cast("long").alias("n_words"))


def alpha_tokens(spark, d):
    return _comments(spark, d).select(
        "imdb_id", "category", F.array_join(X.alpha_tokens(F.col("comment")), " ").alias("clean_comment")
    )


def sentence_tag(spark, d):
    return G.training_corpus(_comments(spark, d)).select("sentence_tag")


def doc_corpus(spark, d):
    return G.training_corpus(_comments(spark, d)).select(
        "sentence_tag", F.array_join("clean_comment", " ").alias("clean_comment")
    )


def category_sizes(spark, d):
    return _comments(spark, d).groupBy("category").agg(F.count("*").alias("n"))


def negative_single(spark, d):
    """Line items as one- or two-word comments: `No`, `Ao`, `Ro`, `No O`."""
    items = T.table(spark, d, "lineitem")
    said = F.when(F.col("l_linestatus") == "O", F.concat("l_returnflag", F.lit("o O"))).otherwise(
        F.concat("l_returnflag", F.lit("o"))
    )
    label = L.denial_label(F.split(said, " "))
    return items.select("l_orderkey", "l_linenumber", label.alias("binary_target"))


def extract_grade(spark, d):
    """Parts as comments that end in `<size> / 10`, plus a second grade for every fifth size."""
    size = F.col("p_size").cast("string")
    sentences = F.array(F.col("p_name"), F.concat(size, F.lit(" / 10")), F.concat(F.lit("10 "), F.col("p_type")))
    tokens = F.when(F.col("p_brand") == "Brand#1", F.split(F.lit("10"), " ")).when(
        F.col("p_brand") == "Brand#2", F.split(F.concat(F.lit("10 10 "), size), " ")
    ).otherwise(X.comment_tokens(sentences))
    return T.table(spark, d, "part").select("p_partkey", L.grade(tokens).cast("long").alias("grade"))


def html_records(spark, d):
    """Navigation lists laid out as result pages; pages with a fragment address have none."""
    item = r'(?is)<li><a href="([^"]*)">([^<]*)</a></li>'
    row = '<div style="width:1000px;"><span><b>No.</b> <i>$2</i></span><div><span>$1</span></div></div>'
    rows = F.regexp_replace(H.inner(F.col("html"), "nav"), item, row)
    head = F.lit('<div style="width:1000px;"><span>TITLE</span><span>LINK</span></div>')
    page = F.when(F.contains("url", F.lit("#")), F.lit("<html><body></body></html>")).otherwise(
        F.concat(F.lit("<html><body>"), head, rows, F.lit("</body></html>"))
    )
    pages = T.table(spark, d, "pages").select("page_id", page.alias("html"))
    records = pages.select("page_id", F.posexplode(H.result_records(F.col("html"))).alias("pos", "r"))
    return records.select(
        "page_id", F.col("pos").cast("long").alias("pos"),
        (F.col("page_id") % 49 + 1968).alias("YEAR"),
        F.col("r")["TITLE"].alias("TITLE"), F.col("r")["LINK"].alias("LINK"),
    )


def page_sections(spark, d):
    """Pages re-laid as guide pages: title, info boxes and comment sections of each, with elements inside."""
    src = F.col("html")
    page = F.concat(
        F.lit('<html><body><a class="main" href="/">'), H.inner(src, "title"),
        F.lit('</a><div class="info"><h5>MPAA:</h5><div><div>'), H.inner(src, "div", 'class="ad"'),
        F.lit('</div> (rated)</div></div><div class="info"><h5>Web Address</h5><div>'), F.col("url"),
        F.lit('</div></div><div class="info"><h5>Certification:</h5><div>UK:15 / USA:'), (F.col("page_id") % 18).cast("string"),
        F.lit('</div></div><div id="swiki.2.1"><h3>Sex &amp; Nudity</h3><div class="display"><div>'),
        H.inner(src, "article"),
        F.lit('</div><p>End</p></div></div><div id="swiki.2.2"><h3>Profanity</h3><div class="display"><p>'),
        H.inner(src, "footer"), F.lit("</p></div></div></body></html>"),
    )
    pages = T.table(spark, d, "pages").select("page_id", page.alias("html"))
    guide = pages.select("page_id", H.guide_record(F.col("html")).alias("r")).select("page_id", "r.*")
    return guide.select(
        "page_id", "title",
        F.col("info")["mpaa_reason"].alias("mpaa_reason"), F.col("info")["web_address"].alias("web_address"),
        F.col("certification")["usa"].alias("usa"),
        F.array_join(F.col("sections")["sex_nudity"], "|").alias("sex_nudity"),
        F.array_join(F.col("sections")["profanity"], "|").alias("profanity"),
    )


def certification_map(spark, d):
    """Customers as certifications: nation, region, then the nation again."""
    customer, nation, region = (T.table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(
        region, nation.n_regionkey == region.r_regionkey
    )
    text = F.concat(
        F.col("n_name"), F.lit(":"), F.col("c_mktsegment"), F.lit(" / "), F.col("r_name"), F.lit(":pg:"),
        F.col("c_name"), F.lit(" / "), F.col("n_name"), F.lit(":"), F.col("c_custkey").cast("string"),
    )
    certified = rows.select("c_custkey", F.explode(H.certification_map(text)).alias("country", "certification"))
    return certified


def crawl_frontier(spark, d):
    """One address per order year and rating; the ratings are exploded on the year's row."""
    years = T.table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    rows = years.select("year", F.explode(F.array(*[F.lit(r) for r in ALL_RATINGS])).alias("rating"))
    url = F.format_string("https://ratings.example.org/search?year=%d&rating=%s", "year", "rating")
    return rows.select(url.alias("url"))


def pending_ids(spark, d):
    wanted = T.table(spark, d, "documents").select("doc_id")
    stored = T.table(spark, d, "labels").select("doc_id").distinct()
    return wanted.join(stored, "doc_id", "left_anti")


def records_per_group(spark, d):
    docs = T.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_id"), "lang")
    return docs.join(T.labels(spark, d), "file_id").groupBy("lang", "rating").agg(F.count("*").alias("n"))


def insert_if_absent(spark, d):
    """First order of each customer, inserted where the supplier table has no such key."""
    supplier = T.table(spark, d, "supplier")
    stored = supplier.select(F.col("s_suppkey").alias("cust"), F.lit(None).cast("long").alias("orderkey"), F.col("s_acctbal").alias("price"))
    orders = T.table(spark, d, "orders")
    new = orders.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"))
    path = scratch_path(spark, "insert")
    writers.replace_with_batches([stored], path)
    writers.insert_if_absent(spark, new, path, "cust", ["orderkey"])
    return spark.read.schema(new.schema).parquet(path)


def stream_insert(spark, d):
    """Orders as they arrive, the first of each customer inserted where the supplier table has none; the last batch comes twice."""
    supplier = T.table(spark, d, "supplier")
    stored = supplier.select(F.col("s_suppkey").alias("cust"), F.lit(None).cast("long").alias("orderkey"), F.col("s_acctbal").alias("price"))
    orders = arriving(spark, d, spark.read.parquet(f"{d}/orders.parquet").schema, "orders.parquet")
    as_records = lambda df: df.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"))
    path = scratch_path(spark, "stream-insert")
    ingest.insert_batch(stored, -1, path, "cust", ["price"])
    ingest.insert_arriving(as_records(orders), path, "cust", ["orderkey"], scratch_path(spark, "insert-checkpoint")).awaitTermination()
    ingest.insert_batch(as_records(T.table(spark, d, "orders")), 0, path, "cust", ["orderkey"])
    return ingest.inserted(stored, path)


def _reasons(spark, d, only=None):
    """Documents as reasons with their tokens; with `only`, those whose record_id it has."""
    docs = T.table(spark, d, "documents")
    records = docs.select(F.col("doc_id").alias("record_id"), F.col("lang").alias("RATING"), F.col("text").alias("REASON"))
    records = records if only is None else records.join(only, "record_id", "left_semi")
    return R.with_reason_tokens(R.reason_rows(records))


def reason_clean(spark, d):
    """Documents as reasons, without those that the label table marks as toxic."""
    docs = T.table(spark, d, "documents")
    records = docs.select(F.col("doc_id").alias("record_id"), F.col("lang").alias("RATING"), F.col("text").alias("REASON"))
    outliers = T.table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("record_id"))
    return R.reason_rows(records, outliers)


def reason_tokens(spark, d):
    return _reasons(spark, d).select("record_id", F.array_join("tokens", " ").alias("tokens"))


def _written_comments(spark, d):
    """(imdb_id, category, comment), written: several steps read the comments, and pages take long to parse."""
    return cut_lineage(_comments(spark, d).select("imdb_id", "category", "comment"))


def _key_words(comments):
    """The telling words of each dimension, from the guide comments about it."""
    tokens = comments.select(F.lower("category").alias("dimension"), X.alpha_tokens(F.col("comment")).alias("tokens"))
    return grouped_key_words(tokens, "dimension", N_KEY_WORDS)


def dimension_key_words(spark, d):
    return _key_words(_written_comments(spark, d)).select("dimension", "term", "weight", F.col("rank").cast("long").alias("rank"))


def dimension_flags(spark, d):
    return R.flag_by_key_words(_reasons(spark, d), _key_words(_written_comments(spark, d)), DIMENSIONS)


def _targets(spark, d):
    """Comments, some with a grade or a denial put in, against the flags of labelled films."""
    page = F.col("imdb_id").cast("long")
    graded = F.concat("comment", F.array((page % 13).cast("string"), F.lit("10")))
    said = F.when(page % 7 == 0, F.array(F.lit("Nil"))).when(page % 5 == 0, graded).otherwise(F.col("comment"))
    written = _written_comments(spark, d)
    comments = written.withColumn("comment", said)
    comments = comments.withColumns({"binary_target": L.denial_label(F.col("comment")), "grade": L.grade(F.col("comment"))})
    labelled = T.table(spark, d, "labels").select(F.col("doc_id").alias("record_id")).distinct()
    flags = R.flag_by_key_words(_reasons(spark, d, labelled), _key_words(written), DIMENSIONS)
    flags = flags.unpivot("record_id", DIMENSIONS, "category", "flagged")
    flags = flags.select(F.col("record_id").cast("string").alias("imdb_id"), F.upper("category").alias("category"), "flagged")
    return G.comment_targets(comments, flags)


def comment_targets(spark, d):
    return _targets(spark, d)


QUERIES = {
    f.__name__: f
    for f in (
        guide_find, unpivot_sections, guide_tokens, rename_categories, n_words, alpha_tokens,
        sentence_tag, doc_corpus, category_sizes, negative_single, extract_grade, html_records,
        page_sections, certification_map, crawl_frontier, pending_ids, records_per_group,
        insert_if_absent, stream_insert, reason_clean, reason_tokens, dimension_key_words, dimension_flags, comment_targets,
    )
}

_ANY = " OR ".join(f"{c} IS NOT NULL" for c in SECTIONS)
_LONG = f"WITH g AS MATERIALIZED ({T.GUIDES_SQL}), l AS ({T.LONG_GUIDES_SQL})"
_NAME = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in GUIDE_CATEGORIES.items()) + " END"
_WORDS = r"regexp_extract_all(lower(array_to_string(sentences, ' ')), '\w+')"
_COMMENTS = f"""{_LONG}, c AS (SELECT imdb_id, {_NAME} AS category, {_WORDS} AS comment
    FROM l WHERE len(sentences) > 0)"""
_ALPHA = "list_filter(comment, lambda w: regexp_matches(w, '^[a-zA-Z]'))"

_REASONS = rf"""
    WITH b AS (SELECT doc_id AS record_id, list_filter(regexp_split_to_array(
            regexp_replace(lower(text), '[^\P{{P}}-]+', ' ', 'g'), '[\s\v\p{{Z}}\x{{1c}}-\x{{1f}}\x{{85}}]+'), lambda w: w <> '') AS words
        FROM documents WHERE text <> ''),
    k AS (SELECT record_id, CASE WHEN list_contains(words, 'for') THEN words[list_position(words, 'for') + 1:]
            WHEN len(words) < 3 THEN [] ELSE words[3:] END AS kept FROM b),
    r AS (SELECT record_id, list_filter(kept, lambda w: w NOT IN {T.STOP_SQL}
            AND NOT regexp_full_match(w, '[!-/:-@\[-`{{-~]')) AS tokens FROM k)"""

_KEY_WORDS = f"""{_COMMENTS},
    a AS MATERIALIZED (SELECT lower(category) AS dimension, list_distinct({_ALPHA}) AS tokens FROM c),
    s AS (SELECT dimension, count(*) AS n_in FROM a GROUP BY dimension),
    u AS (SELECT dimension, term, count(*) AS df_in FROM (SELECT dimension, unnest(tokens) AS term FROM a) GROUP BY dimension, term),
    o AS (SELECT *, sum(df_in) OVER (PARTITION BY term) AS df FROM u JOIN s USING (dimension)),
    w AS (SELECT dimension, term, round(df_in::DOUBLE / n_in * ln(((SELECT count(*) FROM a) + 1 - n_in)::DOUBLE / (df - df_in + 1)), 9) AS weight FROM o),
    q AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY weight DESC, term) AS rank FROM w QUALIFY rank <= {N_KEY_WORDS})"""
_FLAGS = f"""{_KEY_WORDS}, {_REASONS.strip().removeprefix("WITH ")},
    h AS (SELECT DISTINCT record_id, dimension FROM (SELECT record_id, unnest(tokens) AS term FROM r) JOIN q USING (term)),
    flags AS (SELECT record_id, {', '.join(f"coalesce(bool_or(dimension = '{name}'), false) AS {name}" for name in DIMENSIONS)}
        FROM r LEFT JOIN h USING (record_id) GROUP BY record_id)"""

ORACLES = {
    "guide_find": f"""
        WITH g AS ({T.GUIDES_SQL})
        SELECT imdb_id, {', '.join(f"array_to_string({c}, '|') AS {c}" for c in SECTIONS)} FROM g WHERE {_ANY}""",
    "unpivot_sections": f"{_LONG} SELECT imdb_id, category, array_to_string(sentences, '|') AS sentences FROM l",
    "guide_tokens": f"""{_LONG}
        SELECT imdb_id, category, CASE WHEN len(sentences) > 0 THEN array_to_string({_WORDS}, ' ') END AS comment FROM l""",
    "rename_categories": f"{_LONG} SELECT imdb_id, {_NAME} AS category FROM l",
    "n_words": f"{_COMMENTS} SELECT imdb_id, category, len(comment) AS n_words FROM c",
    "alpha_tokens": f"{_COMMENTS} SELECT imdb_id, category, array_to_string({_ALPHA}, ' ') AS clean_comment FROM c",
    "sentence_tag": f"{_COMMENTS} SELECT category || '_' || imdb_id AS sentence_tag FROM c",
    "doc_corpus": f"""{_COMMENTS}
        SELECT category || '_' || imdb_id AS sentence_tag, array_to_string({_ALPHA}, ' ') AS clean_comment FROM c""",
    "category_sizes": f"{_COMMENTS} SELECT category, count(*) AS n FROM c GROUP BY category",
    "negative_single": """
        SELECT l_orderkey, l_linenumber,
            CASE WHEN l_linestatus <> 'O' AND l_returnflag = 'N' THEN 'NEGATIVE' END AS binary_target
        FROM lineitem""",
    "extract_grade": """
        SELECT p_partkey, CAST(CASE WHEN p_brand = 'Brand#1' THEN NULL WHEN p_brand = 'Brand#2' THEN 10
            WHEN p_size < 11 THEN p_size ELSE 10 END AS BIGINT) AS grade
        FROM part""",
    "html_records": r"""
        WITH n AS (SELECT page_id, regexp_extract(html, '(?is)<nav[^>]*>(.*?)</nav>', 1) AS nav
                   FROM pages WHERE url NOT LIKE '%#%'),
        i AS (SELECT page_id, unnest(range(len(t))) AS pos, t, h FROM (
            SELECT page_id, regexp_extract_all(nav, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS t,
                regexp_extract_all(nav, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS h FROM n))
        SELECT page_id, pos, page_id % 49 + 1968 AS YEAR, 'No. ' || replace(t[pos + 1], '&amp;', '&') AS TITLE, replace(h[pos + 1], '&amp;', '&') AS LINK FROM i""",
    "page_sections": f"""
        SELECT page_id, {T._decode_sql(T.inner_sql('title'))} AS title,
            lower({T._decode_sql("regexp_replace(" + T.inner_sql('div', 'class="ad"') + ", '<[^>]*>', '', 'g')")}) || ' (rated)' AS mpaa_reason,
            lower(url) AS web_address, CAST(page_id % 18 AS VARCHAR) AS usa,
            array_to_string(list_append({T.strings_sql(T.inner_sql('article'))}, 'End'), '|') AS sex_nudity,
            array_to_string({T.strings_sql(T.inner_sql('footer'))}, '|') AS profanity
        FROM pages""",
    "certification_map": r"""
        WITH c AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
        SELECT c_custkey, lower(n_name) AS country, CAST(c_custkey AS VARCHAR) AS certification FROM c
        UNION ALL SELECT c_custkey, replace(lower(r_name), ' ', '_'), 'pg:' || c_name FROM c""",
    "crawl_frontier": f"""
        SELECT 'https://ratings.example.org/search?year=' || CAST(y AS VARCHAR) || '&rating=' || r AS url
        FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders), (SELECT unnest({ALL_RATINGS}) AS r)""",
    "pending_ids": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "records_per_group": f"""
        SELECT lang, rating, count(*) AS n FROM documents JOIN ({T.LABELS_SQL}) l USING (doc_id) GROUP BY lang, rating""",
    "insert_if_absent": """
        SELECT s_suppkey AS cust, CAST(NULL AS BIGINT) AS orderkey, s_acctbal AS price FROM supplier
        UNION ALL SELECT o_custkey, min(o_orderkey), arg_min(o_totalprice, o_orderkey) FROM orders
        WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY o_custkey""",
    "stream_insert": """
        SELECT s_suppkey AS cust, CAST(NULL AS BIGINT) AS orderkey, s_acctbal AS price FROM supplier
        UNION ALL SELECT o_custkey, min(o_orderkey), arg_min(o_totalprice, o_orderkey) FROM orders
        WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY o_custkey""",
    "reason_clean": """
        SELECT doc_id AS record_id, lang AS RATING, text AS REASON FROM documents
        WHERE text <> '' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "reason_tokens": f"{_REASONS} SELECT record_id, array_to_string(tokens, ' ') AS tokens FROM r",
    "dimension_key_words": f"{_KEY_WORDS} SELECT dimension, term, weight, rank FROM q",
    "dimension_flags": f"{_FLAGS} SELECT * FROM flags",
    "comment_targets": f"""
        {_FLAGS}, x AS (SELECT imdb_id, category, CAST(imdb_id AS BIGINT) AS page, comment FROM c),
        y AS (SELECT imdb_id, category, CASE WHEN page % 7 = 0 THEN ['Nil'] WHEN page % 5 = 0
            THEN list_concat(comment, [CAST(page % 13 AS VARCHAR), '10']) ELSE comment END AS t FROM x),
        z AS (SELECT imdb_id, category, len(t) = 1 AND lower(t[1]) IN ({', '.join(f"'{w}'" for w in DENIALS)}) AS denied,
            list_filter(list_transform(range(len(t)), lambda i: CASE WHEN t[i + 1] = '10' THEN CASE WHEN i = 0 THEN CASE WHEN t[2] = '10' THEN 10 END
                WHEN TRY_CAST(t[i] AS INT) < 11 THEN TRY_CAST(t[i] AS INT) END END), lambda g: g IS NOT NULL)[1] AS grade FROM y),
        v AS (UNPIVOT (SELECT * FROM flags WHERE record_id IN (SELECT doc_id FROM labels)) ON {', '.join(DIMENSIONS)} INTO NAME dimension VALUE flagged)
        SELECT z.imdb_id, z.category, CASE WHEN denied THEN 0 WHEN grade IS NOT NULL THEN (grade >= 5)::INT ELSE flagged::INT END AS label,
            CASE WHEN denied THEN 'denial' WHEN grade IS NOT NULL THEN 'grade' WHEN flagged IS NOT NULL THEN 'flag' END AS vote
        FROM z LEFT JOIN v ON CAST(v.record_id AS VARCHAR) = z.imdb_id AND upper(v.dimension) = z.category""",
}
