"""Registered queries over the text tables and the SQL of those it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamscore.llm import bpe, packing
from streamscore.llm.clustering import cluster
from streamscore.llm.fingerprint import fingerprints
from streamscore.llm.html_text import extract
from streamscore.llm.licences import licence_scan
from streamscore.llm.minhash import near_duplicates
from streamscore.llm.mixing import mix
from streamscore.llm.quality import quality_rules
from streamscore.llm.search import ranked_search
from streamscore.llm.substring_dedup import substring_dedup
from streamscore.llm.suffix_dedup import suffix_dedup
from streamscore.llm.warc import archive_round_trip
from streamscore.llm.words import documents, pages
from streamscore.session import prepare
from streamscore.sources.storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(prepare(spark), sf_dir)
    return f


@query
def op1_mixing(spark, sf_dir):
    """How many words of each document does a mix with source weights 5, 2, 1 take?"""
    return mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


@query
def op2_substring_dedup(spark, sf_dir):
    """Which words lie in windows of 50 that also start in an earlier document?"""
    return substring_dedup(documents(spark, sf_dir)).select(
        "doc_id",
        F.col("n_units").alias("n_words"),
        "n_removed",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


ORACLE["op2_substring_dedup"] = r"""
    with split as (
        select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
    ), windows as (
        select doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) as same
        from (select *, unnest(range(1, len(words) - 48)) as i from split where len(words) >= 50)
    ), late as (
        select doc_id, i from (select *, min(doc_id) over (partition by same) as first from windows)
        where first < doc_id
    ), gone as (
        select distinct doc_id, unnest(range(i, i + 50)) as j from late
    ), numbered as (
        select doc_id, unnest(range(1, len(words) + 1)) as j, unnest(words) as word from split
    ), kept as (
        select n.doc_id, count(*) as n, string_agg(word, ' ' order by n.j) as text
        from numbered n anti join gone g on n.doc_id = g.doc_id and n.j = g.j group by n.doc_id
    )
    select s.doc_id, len(words) as n_words, len(words) - coalesce(k.n, 0) as n_removed,
        sha256(coalesce(k.text, '')) as kept_sha256
    from split s left join kept k on s.doc_id = k.doc_id
"""


@query
def op3_byte_bpe(spark, sf_dir):
    """How is every text encoded by a public vocabulary, and is it decoded again?"""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(encoded, path).select(
        "doc_id",
        "n_tokens",
        F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op4_suffix_dedup(spark, sf_dir):
    """Which bytes lie in strings of 400 bytes that start anywhere else, too?"""
    return suffix_dedup(documents(spark, sf_dir)).select(
        "doc_id",
        F.col("n_units").alias("n_bytes"),
        "n_removed",
        "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


@query
def op5_html_text(spark, sf_dir):
    """What is the main text of each page?"""
    return extract(pages(spark, sf_dir))


ORACLE["op5_html_text"] = r"""
    with articles as (
        select page_id, url, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|<footer>|$)', 1) as body
        from pages
    ), decoded as (
        select page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
            regexp_replace(body, '<[^>]*>', ' ', 'g'),
            '&quot;?', '"', 'g'), '&(#39|#x27|apos);?', '''', 'g'),
            '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') as body
        from articles
    ), texts as (
        select page_id, url, trim(regexp_replace(body, '\s+', ' ', 'g')) as text from decoded
    )
    select page_id, url, text, length(text) as n_chars from texts
"""


@query
def op6_quality_rules(spark, sf_dir):
    """Which documents pass the base rules and are no outliers in their language and source?"""
    return quality_rules(documents(spark, sf_dir))


@query
def op7_minhash_dedup(spark, sf_dir):
    """Which documents are near copies by shingles of two words, and which one stays?"""
    return near_duplicates(documents(spark, sf_dir))


ORACLE["op7_minhash_dedup"] = r"""
    with recursive split as (
        select doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') as words
        from documents
    ), shingles as (
        select distinct doc_id, words[i] || coalesce(' ' || words[i + 1], '') as shingle
        from (select *, unnest(range(1, greatest(len(words), 2))) as i from split where len(words) > 0)
    ), sizes as (
        select doc_id, count(*) as n from shingles group by doc_id
    ), common as (
        select a.doc_id as a, b.doc_id as b, count(*) as n
        from shingles a join shingles b on a.shingle = b.shingle and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
    ), links as (
        select a, b from common c join sizes x on a = x.doc_id join sizes y on b = y.doc_id
        where 100 * c.n >= 80 * (x.n + y.n - c.n)
    ), ways as (
        select a, b from links union all select b, a from links
    ), reached as (
        select a as doc_id, b as other from ways
        union select r.doc_id, w.b from reached r join ways w on r.other = w.a
    ), firsts as (
        select doc_id, min(other) as first from reached group by doc_id
    )
    select d.doc_id, coalesce(s.n, 0) as n_shingles,
        least(d.doc_id, coalesce(f.first, d.doc_id)) as component_id,
        d.doc_id <= coalesce(f.first, d.doc_id) as kept
    from documents d left join sizes s on d.doc_id = s.doc_id left join firsts f on d.doc_id = f.doc_id
"""


@query
def op8_licence_scan(spark, sf_dir):
    """Which licences do the paragraphs of each document name?"""
    found = licence_scan(documents(spark, sf_dir))
    families = F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"])))
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("licences").cast("long").alias("n_licences"),
        F.array_join(families, ",").alias("families"),
    )


@query
def op9_warc(spark, sf_dir):
    """What do the archives written from all pages hold when they are read back?"""
    return archive_round_trip(pages(spark, sf_dir))


ORACLE["op9_warc"] = """
    with hashed as (
        select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes,
            sha1(coalesce(html, '')) as hex, sha256(coalesce(html, '')) as same from pages
    ), bits as (
        select *, max(page_id) over (partition by same) as first,
            [('0x' || substr(hex, 2 * i + 1, 2))::int for i in range(20)] as bytes
        from hashed
    )
    select page_id, payload_bytes,
        list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((
            (bytes[(5 * k) // 8 + 1] * 256 + coalesce(bytes[(5 * k) // 8 + 2], 0))
            >> (11 - (5 * k) % 8)) & 31 as int), 1) for k in range(32)], 'string_agg', '') as payload_digest,
        case when page_id = first then 'response' else 'revisit' end as record_type,
        case when page_id <> first then first end as refers_to
    from bits
"""


@query
def op10_fingerprints(spark, sf_dir):
    """How like are fingerprints of texts, of edited texts and of the next documents?"""
    return fingerprints(documents(spark, sf_dir))


@query
def op11_ranked_search(spark, sf_dir):
    """Which 20 documents answer each benchmark item best?"""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return ranked_search(documents(spark, sf_dir), items).drop("query")


ORACLE["op11_ranked_search"] = r"""
    with words as (
        select doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
        from documents
    ), wanted as (
        select item_id, unnest(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
        from benchmark
    ), whole as (
        select count(*) as docs, sum(len(terms))::bigint as n_terms from words where len(terms) > 0
    ), lengths as (
        select doc_id, 100 - 25 + (25 * len(terms) * docs) // n_terms as m from words, whole where len(terms) > 0
    ), postings as (
        select doc_id, term, count(*) as tf from (select doc_id, unnest(terms) as term from words)
        where term in (select term from wanted) group by doc_id, term
    ), weights as (
        select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w
        from (select term, count(*) as df from postings group by term), whole
    ), scores as (
        select item_id, doc_id,
            sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
        from wanted join postings using (term) join weights using (term) join lengths using (doc_id)
        group by item_id, doc_id
    )
    select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank,
        doc_id, score
    from scores where score > 0
    qualify rank <= 20
"""


@query
def op12_best_fit_packing(spark, sf_dir):
    """Into which sequences of 2048 tokens do the pieces of all documents go?"""
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pieces(documents(spark, sf_dir), path)
    items = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(stored(items, "pieces"))


@query
def op13_centroids(spark, sf_dir):
    """To which of 40 centroids does each embedding belong after five rounds?"""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _centroid_sql(rounds: int = 5, clusters: int = 40) -> str:
    nearest = """
        select vec_id, v, unnest(min_by(struct_pack(cluster := cluster, distance := d), (d, cluster))) from (
            select p.vec_id, p.v, c.cluster,
                list_sum(list_transform(list_zip(p.v, c.c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::bigint as d
            from points p, c{0} c
        ) group by vec_id, v
    """
    steps = []
    for k in range(rounds):
        steps.append(f"a{k} as materialized ({nearest.format(k)})")
        steps.append(f"""
        c{k + 1} as materialized (
            select cluster, coalesce(m.c, c{k}.c) as c from c{k} left join (
                select cluster, list(x order by place) as c from (
                    select cluster, place, floor(sum(x)::bigint // count(*)
                        - case when sum(x) < 0 and sum(x) % count(*) <> 0 then 1 else 0 end)::bigint as x
                    from (select cluster, unnest(v) as x, unnest(range(64)) as place from a{k})
                    group by cluster, place
                ) group by cluster
            ) m using (cluster)
        )""")
    return f"""
    with points as materialized (
        select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
        from embeddings
        where len(embedding) = 64 and len(list_filter(embedding, lambda x: isfinite(x))) = 64
    ), c0 as materialized (
        select (row_number() over (order by h) - 1)::int as cluster, v as c
        from (select v, sha256('2:' || vec_id) as h from points order by h limit {clusters})
    ), {", ".join(steps)}, a as materialized ({nearest.format(rounds)})
    select vec_id, cluster, distance,
        (sum(distance) over (partition by cluster))::bigint as cluster_inertia,
        (sum(distance) over ())::bigint as inertia,
        sha256(array_to_string(c, ',')) as centroid_sha256
    from a join c{rounds} using (cluster)
    """


ORACLE["op13_centroids"] = _centroid_sql()
