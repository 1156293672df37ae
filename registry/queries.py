"""One query per operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from folioscope.functions.hooks import complete, lead_reply, normalize_reply
from folioscope.functions.messages import message, message_from_json, message_str, message_to_json, to_request
from folioscope.functions.properties import merge_metadata, metadata_map
from folioscope.functions.rows import unnest
from folioscope.functions.text import content_text, lead_sentences, n_tokens, two_decimals
from folioscope.functions.tokens import Vocabulary
from folioscope.operators.approximate import approximate_knn, recall
from folioscope.operators.blocks import classify_blocks, group_runs, read_blocks
from folioscope.operators.context import build_prompt, number_context
from folioscope.operators.embedding import embed, term_counts
from folioscope.operators.knn import knn
from folioscope.operators.packing import chunk_arrays, explode_chunks, pack_chunks
from folioscope.operators.ranking import fuse, query_report, reciprocal_rank, shortlist, shortlist_report
from folioscope.operators.relations import resolve_relations
from folioscope.operators.summary import base_metadata, build_summary_prompt, full_text, summarize
from folioscope.operators.usage import running_usage, usage_by
from folioscope.plans.answer import context_of, nearest_snippets, retrieve_snippets, shortlist_vectors, snippet_texts, split_queries, transcript
from folioscope.plans.ingest import LoaderConfig, Source, chunk_rows, open_indexes, run_ingest
from folioscope.schema import MARKS
from folioscope.session import cut_lineage, run_dir
from folioscope.sources.pages import changed_by_loader, changed_pages, fetch_pages, page_blocks, project_metadata, write_page_log
from folioscope.sources.raw import raw_blocks
from folioscope.sources.tables import advance_mark, latest_per_key, open_index, read_mark, stamp, stamp_text, upsert, write_batch, write_mark
from folioscope.streaming.ingest import index_stream, ingest_stream, usage_stream
from registry import views as V

Query = Callable[[SparkSession, str], DataFrame]
EDIT = ["last_edited", "edit_id"]


def _doc_id(df: DataFrame, source: str = "page_id") -> DataFrame:
    return df.withColumn("doc_id", F.col(source).cast("bigint"))


# Sources and sinks


def q_changed_pages(spark, sf):
    edits = V.edits(spark, sf)
    changed = changed_pages(edits, V.mark(), keep=["edit_id", "last_edited", "title"])
    return latest_per_key(changed, "page_id", EDIT)


def _loaders(edits: DataFrame) -> DataFrame:
    known = edits.select(F.col("title").alias("loader")).distinct()
    return known.unionByName(edits.sparkSession.range(1).select(F.lit("never_run").alias("loader")))


def _marks(edits: DataFrame) -> DataFrame:
    return edits.groupBy(F.col("title").alias("loader")).agg(F.max("last_edited").alias("ts"))


def q_read_mark(spark, sf):
    edits = V.edits(spark, sf)
    return read_mark(_marks(edits), _loaders(edits))


def q_advance_mark(spark, sf):
    edits = V.edits(spark, sf)
    old = _marks(edits.filter(F.col("last_edited") <= V.mark()))
    return advance_mark(old, _marks(edits.filter(F.col("value") > 50)))


def q_upsert_pages(spark, sf):
    edits = V.edits(spark, sf).select("page_id", "edit_id", "title", "last_edited")
    before = latest_per_key(edits.filter(F.col("last_edited") <= V.mark()), "page_id", EDIT)
    after = latest_per_key(edits.filter(F.col("last_edited") > V.mark()), "page_id", EDIT)
    return upsert(before, after, "page_id").drop("last_edited")


def q_ingest_by_loader(spark, sf):
    edits = V.edits(spark, sf).withColumnRenamed("title", "loader")
    state = _marks(V.edits(spark, sf).filter(F.col("last_edited") <= V.mark()))
    fresh = changed_by_loader(edits, read_mark(state, edits.select("loader").distinct()), salt_by=["edit_id"])
    return latest_per_key(fresh.select("loader", "page_id", *EDIT), ["loader", "page_id"], EDIT).select("loader", "page_id", "edit_id")


def q_fetch_pages(spark, sf):
    ids = V.table(spark, sf, "labels").filter("toxic = 1")
    return fetch_pages(V.table(spark, sf, "documents"), ids, "doc_id")


def q_page_blocks(spark, sf):
    pages = V.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("page_id"))
    return _doc_id(page_blocks(V.blocks(spark, sf), pages)).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("text").alias("txt"))


def q_page_blocks_first(spark, sf):
    """The first blocks of every page, as one listing call of the source holds them."""
    blocks = page_blocks(V.blocks(spark, sf), V.documents(spark, sf).select(F.col("doc_id").cast("string").alias("page_id")), 3)
    return _doc_id(blocks).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("text").alias("txt"))


def q_mark_text(spark, sf):
    """Marks from stamps with a zone, through a stored table, back to text."""
    zoned = V.edits(spark, sf).select(F.col("title").alias("loader"), stamp(F.concat(F.date_format("last_edited", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00"))).alias("ts"))
    path = run_dir(spark, "marks")
    write_mark(zoned.groupBy("loader").agg(F.max("ts").alias("ts")), path)
    marks = read_mark(open_index(spark, path, MARKS), _loaders(V.edits(spark, sf)))
    return marks.select("loader", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.substring(stamp_text(F.col("ts")), 27, 6)).alias("mark"))


def q_index_upsert(spark, sf):
    """A table written in three upserts that overlap, opened again and read."""
    edits = V.edits(spark, sf)
    path = run_dir(spark, "edits-table")
    third = F.pmod(F.xxhash64("edit_id"), F.lit(3))
    for part in range(3):
        write_batch(latest_per_key(edits.filter(third == part), "page_id", EDIT), path, "page_id", EDIT)
    return open_index(spark, path, edits.schema).select("page_id", "edit_id", "title")


def _ingested(spark, sf) -> tuple[dict[str, bool], str]:
    """Two sources read from end to end into both indexes, once an application; a second run finds nothing new."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _runs:
        _runs[key] = _ingest(spark, sf)
    return _runs[key]


_runs: dict[tuple[str, str], tuple[dict[str, bool], str]] = {}


def _ingest(spark, sf) -> tuple[dict[str, bool], str]:
    root, pages, blocks = run_dir(spark, "ingest"), V.stored_pages(spark, sf), V.stored_blocks(spark, sf)
    number = F.col("page_id").cast("bigint")
    sources = [Source(name, pages.filter(number % 2 == rest), blocks, LoaderConfig(edited="Edited", metadata=metadata, max_tokens=V.MAX_TOKENS))
               for name, rest, metadata in (("even", 0, {"source": "Source"}), ("odd", 1, {"title": "Source"}))]
    fed = run_ingest(spark, sources, root)
    again = run_ingest(spark, sources, root)
    return {name: fed[name] and not again[name] for name in fed}, root


def _vector_total(embedding: str = "embedding"):
    return F.aggregate(embedding, F.lit(0.0), lambda a, x: a + x).cast("bigint")


def q_ingest_chunks(spark, sf):
    rows = open_indexes(spark, _ingested(spark, sf)[1])["chunk"]
    meta = F.col("metadata")
    return rows.select("id", F.col("doc_id").cast("bigint").alias("doc_id"), F.col("chunk_id").cast("bigint").alias("chunk_id"), meta["title"].alias("title"),
                       meta["source"].alias("source"), meta["last_edited_time"].alias("last_edited_time"), "document", _vector_total().alias("n_words"))


def q_ingest_summaries(spark, sf):
    rows = open_indexes(spark, _ingested(spark, sf)[1])["summary"]
    meta = F.col("metadata")
    return rows.select(F.col("id").cast("bigint").alias("doc_id"), meta["title"].alias("title"), meta["source"].alias("source"), "document", _vector_total().alias("n_words"))


def q_ingest_sources(spark, sf):
    """Where each source's mark stands after the run, and how many rows it fed to each index."""
    fed, root = _ingested(spark, sf)
    indexes = open_indexes(spark, root)
    rows = indexes["chunk"].select("doc_id", F.lit(1).alias("chunk")).unionByName(indexes["summary"].select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk")))
    name = F.when(F.col("doc_id").cast("bigint") % 2 == 0, "even").otherwise("odd")
    counts = rows.groupBy(name.alias("loader")).agg(F.sum("chunk").alias("n_chunks"), F.sum(1 - F.col("chunk")).alias("n_summaries"))
    marks = open_index(spark, f"{root}/marks", MARKS).select("loader", F.unix_seconds("ts").alias("mark_s"))
    once = F.col("loader").isin([n for n, ok in fed.items() if ok])
    return counts.join(marks, "loader").select("loader", "n_chunks", "n_summaries", "mark_s", once.alias("fed_once"))


def q_stream_ingest(spark, sf):
    """The edit log arrives as a folder of files and is upserted file by file."""
    edits = V.edits(spark, sf)
    folder, path, checkpoint = (run_dir(spark, name) for name in ("edits", "index", "stream"))
    edits.repartitionByRange(4, "last_edited").write.parquet(folder)
    schema = T.StructType([f for f in edits.schema.fields])
    ingest_stream(spark, folder, schema, path, checkpoint, "page_id", EDIT, max_files=1).awaitTermination()
    return open_index(spark, path, schema).select("page_id", "edit_id", "title")


def q_stream_indexes(spark, sf):
    """Pages arrive as a stream of files: an old edit of every page, its last one, then, late, old ones again and repeated last ones."""
    pages, root, folder, checkpoint = V.stored_pages(spark, sf), *(run_dir(spark, name) for name in ("stream", "page-edits", "stream-checkpoint"))
    wrong = F.transform_values("properties", lambda k, v: F.when(k == "Title", v.withField("title", F.array(F.struct(F.lit("old").alias("plain_text"))))).otherwise(v))
    number = F.col("page_id").cast("bigint")
    early = pages.withColumns({"last_edited": F.col("last_edited") - F.expr("interval 1 day"), "properties": wrong})
    cfg = LoaderConfig(edited="Edited", metadata={"source": "Source"}, max_tokens=V.MAX_TOKENS)
    files = spark.sparkContext.defaultParallelism

    def arrive(*parts: DataFrame) -> None:
        for part in parts:  # up to a file a slot, all edits of a page in one, so that they come with one micro-batch
            part.repartition(files, "page_id").write.mode("append").parquet(folder)
        stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", files).parquet(folder)
        index_stream(stream, V.stored_blocks(spark, sf), root, checkpoint, cfg=cfg).awaitTermination()

    arrive(early, pages)
    arrive(early.filter(number % 3 == 0).unionByName(pages.filter(number % 5 == 0)))  # after a restart
    indexes = open_indexes(spark, root)
    title = F.col("metadata")["title"].alias("title")
    return indexes["chunk"].select(F.lit("chunk").alias("kind"), "id", title, "document").unionByName(
        indexes["summary"].select(F.lit("summary").alias("kind"), "id", title, "document"))


def q_changed_pages_log(spark, sf):
    """The edit log stored by day; only the days from the mark on are read."""
    path = run_dir(spark, "page-log")
    write_page_log(V.edits(spark, sf), path)
    changed = changed_pages(spark.read.parquet(path), V.mark(), keep=["edit_id", "last_edited", "title"])
    return latest_per_key(changed, "page_id", EDIT)


# Properties


MAPPING = {"title": "Title", "source": "Source", "date": "Date", "edited": "Edited", "files": "Files", "none": "Missing"}


def _entries(df: DataFrame, column: str = "metadata") -> DataFrame:
    return df.select("doc_id", F.explode_outer(column).alias("key", "value")).filter(F.col("key").isNotNull())


def q_props(spark, sf):
    bags = V.described(spark, sf)
    return _entries(_doc_id(bags.withColumn("metadata", metadata_map(F.col("properties"), MAPPING))))


def q_relation_titles(spark, sf):
    resolved = resolve_relations(V.described(spark, sf), ["Related"])
    return _doc_id(resolved).select("doc_id", F.col("related")["Related"].alias("related"))


def q_project_metadata(spark, sf):
    pages = project_metadata(V.described(spark, sf), {"title": "Source", "related": "Related", "date": "Date"}, "Title", "Edited")
    rows = _doc_id(pages)
    return rows.select("doc_id", "title", "last_edited_time", F.col("metadata")["title"].alias("meta_title"),
                       F.col("metadata")["related"].alias("meta_related"), F.col("metadata")["date"].alias("meta_date"))


def q_merged_metadata(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("last_edited_time"))
    labels = V.table(spark, sf, "labels").select(
        "doc_id", F.create_map(F.lit("title"), F.concat(F.lit("quality "), F.col("quality").cast("string")),
                               F.lit("toxic"), F.when(F.col("toxic") == 1, F.lit("yes"))).alias("extra"))
    merged = docs.join(labels, "doc_id", "left").withColumn("metadata", merge_metadata(base_metadata("title", "last_edited_time"), F.col("extra")))
    return _entries(merged)


# Blocks and chunks


def q_block_classes(spark, sf):
    return classify_blocks(V.blocks(spark, sf)).groupBy("btype", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("n_tok"))


def q_raw_blocks(spark, sf):
    """Documents as lists of block objects in JSON, read back as blocks."""
    lines = F.transform(F.split("text", "\n", -1), lambda line, i: F.concat(
        F.lit('{"type": "'), V.block_type(i), F.lit('", "'), V.block_type(i), F.lit('": '),
        F.to_json(F.struct(F.transform(F.array(line, F.lit("|")), lambda t: F.struct(t.alias("plain_text"))).alias("rich_text"),
                           F.when(i % 4 == 0, F.array(F.lit("fig "), i.cast("string"))).alias("caption"),
                           F.when(i % 5 == 0, F.lit("x")).alias("expression"))), F.lit("}")))
    pages = V.documents(spark, sf).select(F.col("doc_id").cast("string").alias("page_id"), lines.alias("blocks"))
    read = read_blocks(raw_blocks(pages))
    return _doc_id(read).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "btype", F.col("text").alias("txt"), F.col("n_tokens").alias("n_tok"))


def q_content_text(spark, sf):
    blocks = V.blocks(spark, sf)
    caption = F.when(F.col("pos") % 4 == 0, F.array(F.lit("fig "), F.col("pos").cast("string")))
    expression = F.when(F.col("pos") % 5 == 0, F.concat(F.lit("x = "), F.col("pos").cast("string")))
    text = content_text(F.col("text"), caption, expression)
    return _doc_id(blocks).select("doc_id", F.col("pos").cast("bigint").alias("pos"), text.alias("txt"))


def q_token_counts(spark, sf):
    return V.documents(spark, sf).select("doc_id", n_tokens(F.col("text")).alias("n_tok"))


def q_token_hook(spark, sf):
    return V.documents(spark, sf).select("doc_id", n_tokens(F.col("text"), str.split).alias("n_tok"))


def q_token_vocabulary(spark, sf):
    """Counts of a byte-pair vocabulary over every text."""
    return V.documents(spark, sf).select("doc_id", n_tokens(F.col("text"), Vocabulary(V.vocabulary_path())).alias("n_tok"))


def q_block_runs(spark, sf):
    return _doc_id(group_runs(V.blocks(spark, sf))).select("doc_id", "run", "kind", "text", F.col("n_tokens").alias("n_tok"))


def q_exploded_chunks(spark, sf):
    """Documents with their chunks as arrays, a row per chunk."""
    docs = chunk_arrays(V.blocks(spark, sf), V.MAX_TOKENS).withColumnRenamed("page_id", "id")
    return explode_chunks(docs).select("id", F.col("doc_id").cast("bigint").alias("doc_id"), F.col("chunk_id").cast("bigint").alias("chunk_id"), "document")


def q_chunks_full(spark, sf):
    """At the default chunk size."""
    packed = pack_chunks(V.blocks(spark, sf), LoaderConfig().max_tokens)
    return _doc_id(packed).select("doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), "text")


def q_chunks(spark, sf):
    return V.chunk_rows(spark, sf).select("id", "doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("document").alias("text"))


def _docs(spark, sf):
    """Documents with chunk arrays, titles and metadata."""
    packed = chunk_arrays(V.blocks(spark, sf), V.MAX_TOKENS).select(F.col("page_id").cast("bigint").alias("doc_id"), "chunks")
    docs = V.titled(V.documents(spark, sf)).select("doc_id", "title", F.col("lang").alias("last_edited_time"),
                                                   F.create_map(F.lit("source"), F.col("source")).alias("metadata"))
    return packed.join(docs, "doc_id").withColumnRenamed("doc_id", "id")


def q_full_text(spark, sf):
    packed = chunk_arrays(V.blocks(spark, sf), V.MAX_TOKENS)
    return _doc_id(full_text(packed)).select("doc_id", "text")


def q_summary_prompt(spark, sf):
    asked = build_summary_prompt(full_text(chunk_arrays(V.blocks(spark, sf), V.MAX_TOKENS)))
    return unnest(_doc_id(asked), ["doc_id"], "messages", "seq", "m").select(
        "doc_id", F.col("seq").cast("bigint").alias("seq"), F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def q_chunk_index(spark, sf):
    """Index rows with merged metadata; the user key ``title`` replaces the built-in one."""
    packed = V.chunk_rows(spark, sf)
    docs = V.titled(V.documents(spark, sf)).select("doc_id", "title", F.col("lang").alias("last_edited_time"),
                                                   F.create_map(F.lit("title"), F.col("source")).alias("metadata"))
    rows = chunk_rows(packed.join(docs, "doc_id"))
    meta = F.col("metadata")
    return rows.select("id", "doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), meta["title"].alias("title"),
                       meta["last_edited_time"].alias("last_edited_time"), meta["chunk_id"].alias("meta_chunk_id"), "document")


def q_summary_index(spark, sf):
    rows = summarize(_docs(spark, sf))
    return rows.select("id", F.col("metadata")["title"].alias("title"), F.col("metadata")["source"].alias("source"), "document")


def q_summary_usage(spark, sf):
    """What summaries cost: the counts of every call, added up."""
    rows = summarize(_docs(spark, sf), lead_reply, options={}, usage=True)
    return usage_by(rows.withColumn("response_us", F.lit(0).cast("bigint")), [], "response_us").drop("response_us")


def q_lead_summary(spark, sf):
    docs = V.titled(V.documents(spark, sf))
    return docs.select(F.col("doc_id").alias("id"), "title", lead_sentences(F.col("text")).alias("document"))


# Vectors


def q_text_vectors(spark, sf):
    rows = term_counts(embed(V.documents(spark, sf).select("doc_id", "text"), "text"), "doc_id")
    return rows.select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), "tf")


def q_embedding_hook(spark, sf):
    """Vectors of a function of the user's: characters and blanks of every text."""
    rows = embed(V.documents(spark, sf).select("doc_id", "text"), "text", fn=lambda texts: [(len(t), t.count(" ")) for t in texts])
    return rows.select("doc_id", *(F.get("embedding", F.lit(i)).cast("bigint").alias(n) for i, n in enumerate(("n_chars", "n_blanks"))))


def q_text_knn_full(spark, sf):
    """At the default number of results."""
    index = embed(V.documents(spark, sf).select("doc_id", "text"), "text").drop("text")
    asked = embed(V.table(spark, sf, "benchmark"), "text", out="qvec").select("item_id", "qvec")
    return _ranked(knn(index, asked, V.FULL.summary_results, ["item_id"], "doc_id"))


def q_text_knn(spark, sf):
    index = embed(V.documents(spark, sf).select("doc_id", "text"), "text").drop("text")
    asked = embed(V.table(spark, sf, "benchmark"), "text", out="qvec").select("item_id", "qvec")
    return _ranked(knn(index, asked, 5, ["item_id"], "doc_id"))


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


def _vector_knn(spark, sf, **how):
    """Every vector asks for its nearest ones."""
    index = V.spread(V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"))
    asked = index.select(F.col("doc_id").alias("qid"), F.col("embedding").alias("qvec"))
    rows = knn(index, asked, V.CONFIG.summary_results, ["qid"], "doc_id", **how)
    return _ranked(rows.withColumn("score", reciprocal_rank(F.col("rank"))))


def q_vector_knn(spark, sf):
    return _vector_knn(spark, sf)


def q_vector_knn_cells(spark, sf):
    """The same answers with the questions in several blocks, as when there are more than one broadcast may hold."""
    return _vector_knn(spark, sf, block_bytes=100_000)


def q_vector_knn_recall(spark, sf):
    """How many of the 20 exact neighbours the approximate form finds, for every 20th vector."""
    index = V.spread(V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))
    asked = index.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    found = approximate_knn(index, asked, V.BUCKET_LENGTH, V.FULL.summary_results, ["qid"])
    return recall(found, knn(index, asked, V.FULL.summary_results, ["qid"]), ["qid"])


# Retrieval


def _asked(spark, sf):
    return embed(V.queries(spark, sf), "query", out="qvec").select("qid", "qpos", "qvec")


def _fused(spark, sf):
    hits = knn(V.summary_index(spark, sf).drop("document"), _asked(spark, sf), V.CONFIG.summary_results, carry=["title"])
    return fuse(hits, attrs=["title"])


def q_fused_scores(spark, sf):
    return _fused(spark, sf).select("qid", F.col("id").alias("doc_id"), "title", "score")


def q_shortlist(spark, sf):
    kept = shortlist(_fused(spark, sf), V.CONFIG.threshold)
    return kept.select("qid", F.col("pos").cast("bigint").alias("pos"), F.col("id").alias("doc_id"), "title", "score")


def _shortlisted(spark, sf):
    return shortlist_vectors(_asked(spark, sf), V.summary_index(spark, sf).drop("document"), V.CONFIG)


def _chosen(spark, sf):
    return cut_lineage(_shortlisted(spark, sf))


def q_shortlist_report(spark, sf):
    return _shortlisted(spark, sf).select("qid", F.col("pos").cast("bigint").alias("pos"), two_decimals(F.col("score")).alias("shown"), "score", "title")


def q_shortlist_text(spark, sf):
    return shortlist_report(_shortlisted(spark, sf))


def q_knn_within(spark, sf):
    near = nearest_snippets(V.questions(spark, sf), _chosen(spark, sf), V.chunk_index(spark, sf), V.CONFIG)
    return _ranked(near).select("qid", "doc_id", "rank", "id", "distance")


def q_knn_within_full(spark, sf):
    """Chunks of 1,024 tokens, 50 a document."""
    near = nearest_snippets(V.questions(spark, sf), _chosen(spark, sf), V.chunk_index_full(spark, sf), V.FULL)
    return _ranked(near).select("qid", "doc_id", "rank", "id", "distance")


def _snippets(spark, sf, index, cfg):
    kept = retrieve_snippets(V.questions(spark, sf), _chosen(spark, sf), index, cfg)
    return kept.select("qid", "id", "doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), "distance", "cum_tokens")


def q_snippets(spark, sf):
    return _snippets(spark, sf, V.chunk_index(spark, sf), V.CONFIG)


def q_snippets_full(spark, sf):
    """At the default chunk size, results and budget."""
    return _snippets(spark, sf, V.chunk_index_full(spark, sf), V.FULL)


def q_doc_snippets(spark, sf):
    chosen = _chosen(spark, sf)
    texts = number_context(chosen, snippet_texts(V.questions(spark, sf), chosen, V.chunk_index(spark, sf), V.CONFIG))
    return texts.select("qid", F.col("number").cast("bigint").alias("number"), "doc_id", "text")


def _context(spark, sf, index, cfg):
    return context_of(V.questions(spark, sf), _chosen(spark, sf), index, cfg)


def q_context(spark, sf):
    """At the default chunk size, results and budget."""
    return _context(spark, sf, V.chunk_index_full(spark, sf), V.FULL)


def q_context_full(spark, sf):
    return _context(spark, sf, V.chunk_index_full(spark, sf), V.FULL)


def _prompt(spark, sf, context):
    asked = build_prompt(context, V.questions(spark, sf))
    return unnest(asked, ["qid"], "messages", "seq", "m").select(
        "qid", F.col("seq").cast("bigint").alias("seq"), F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def q_prompt(spark, sf):
    return _prompt(spark, sf, _context(spark, sf, V.chunk_index(spark, sf), V.CONFIG))


def q_prompt_full(spark, sf):
    return _prompt(spark, sf, q_context_full(spark, sf))


def _answers(spark, sf, context):
    """Prompts through the completion map with its offline default: the reply repeats the question."""
    replies = normalize_reply(complete(build_prompt(context, V.questions(spark, sf))), strict=True)
    return replies.select("qid", F.col("reply_role").alias("role"), F.col("reply_content").alias("content"), "completion_tokens")


def q_answers(spark, sf):
    return _answers(spark, sf, _context(spark, sf, V.chunk_index(spark, sf), V.CONFIG))


def q_answers_full(spark, sf):
    return _answers(spark, sf, q_context_full(spark, sf))


def _sentences(messages):
    """Offline search queries: the sentences of the question."""
    asked = messages[-1]["content"]
    return {"role": "assistant", "content": asked.replace(". ", ";")}, {"completion_tokens": len(asked), "prompt_tokens": len(messages)}


def _transcript(spark, sf, index, cfg):
    summaries = V.summary_index(spark, sf).withColumn("metadata", base_metadata("title"))
    said = transcript(V.questions(spark, sf), summaries, index, _sentences, lead_reply, cfg)
    return said.select("qid", F.col("seq").cast("bigint").alias("seq"), "role", "content", "completion_tokens")


def q_transcript(spark, sf):
    """Everything an asker sees, with both completion maps on their offline functions."""
    return _transcript(spark, sf, V.chunk_index(spark, sf), V.CONFIG)


def q_transcript_full(spark, sf):
    return _transcript(spark, sf, V.chunk_index_full(spark, sf), V.FULL)


# Messages and accounting


def _turns(spark, sf):
    return V.table(spark, sf, "conversations")


def q_split_queries(spark, sf):
    rows = split_queries(_turns(spark, sf).filter("role = 'user'"), "text", ".", ["conv_id", "turn"])
    return rows.withColumn("qpos", F.col("qpos").cast("bigint"))


def q_query_report(spark, sf):
    return query_report(V.queries(spark, sf))


def q_requests(spark, sf):
    """Every turn as a request of an instruction and the turn; the turn goes through JSON and back on the way."""
    turn = message(F.col("role"), F.col("text"), F.lit("2024-01-01T00:00:00"))
    sent = _turns(spark, sf).select("conv_id", "turn", to_request(F.array(
        message("system", F.lit("go on")), message_from_json(message_to_json(turn)))).alias("request"))
    return unnest(sent, ["conv_id", "turn"], "request", "seq", "m").select(
        "conv_id", "turn", F.col("seq").cast("bigint").alias("seq"), F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def q_replies(spark, sf):
    padded = _turns(spark, sf).withColumn("text", F.concat(F.lit(" \n"), F.col("text"), F.lit("\t ")))
    flagged = normalize_reply(padded, "role", "text")
    rendered = message_str(F.struct("role", F.col("text").alias("content")))
    return flagged.select("conv_id", "turn", "ok", F.col("text").alias("content"), rendered.alias("rendered"))


def q_completions(spark, sf):
    """Every conversation as one request."""
    said = F.array_sort(F.collect_list(F.struct("turn", message(F.col("role"), F.col("text")).alias("m"))))
    asked = _turns(spark, sf).groupBy("conv_id").agg(F.transform(said, lambda t: t["m"]).alias("messages"))
    return complete(asked).select("conv_id", "reply_role", "reply_content", "completion_tokens", "prompt_tokens")


def q_usage(spark, sf):
    return usage_by(V.calls(spark, sf), ["qid", "model"], "response_us")


def q_usage_by_model(spark, sf):
    return usage_by(V.calls(spark, sf), ["model"], "response_us")


def q_usage_stream(spark, sf):
    """Calls arrive as a stream of files, the second half after a restart."""
    calls = V.calls(spark, sf)
    folder, path, checkpoint = (run_dir(spark, name) for name in ("calls", "usage", "usage-checkpoint"))
    half = F.pmod(F.xxhash64("qid", "turn"), F.lit(2))
    for part in range(2):
        calls.filter(half == part).repartition(2).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        usage_stream(stream, path, checkpoint, ["model"]).awaitTermination()
    return open_index(spark, path, usage_by(calls, ["model"], "response_us").schema)


def q_running_usage(spark, sf):
    return running_usage(V.calls(spark, sf), ["model"], ["qid", "turn"], "response_us")


QUERIES: dict[str, Query] = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_")}
