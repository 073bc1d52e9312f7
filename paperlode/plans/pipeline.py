"""From files to answers: ingest into stores, then ask. Models are injected; without one the facts still answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.functions.scalars import est_tokens
from paperlode.operators import answers, facts, grounding, ingest, listing, retrieval, text
from paperlode.session import checkpoint
from paperlode.sources import files, stores

#: Tokens of a prompt's passages and facts; passages wanted.
CONTEXT, TOP_K = 3000, 5
# What a model is told.
RULES = "Answer only from the numbered passages. Cite them as [1], [2]. Copy figures exactly. Say so if the passages do not hold the answer."
NOTHING = "Nothing has been ingested for this question."


class ChatModel(Protocol):
    """M2: a language model: pieces of an answer for messages of (role, text)."""

    def __call__(self, messages: list[tuple[str, str]]) -> Iterator[str]: ...


#: Documents whose facts go before the passages of a prompt.
FACT_DOCS = 3
# What marks the facts in a prompt, and what an answer from facts says of itself.
FACTS_MARK = "[F] DOCUMENT FACTS"
NOTE = "\n\n_Read directly from the documents at upload; no model involved. Use **Ask the model** for explanations or specific transactions._"


def numbered_lines(pages: DataFrame) -> DataFrame:
    """The lines of pages with numbers that follow page and place."""
    return text.lines(pages).withColumn("line_no", F.col("page").cast("bigint") * 1_000_000_000 + F.col("pos")).withColumn("loaded_at", F.current_timestamp())


class Library:
    """Stores under one folder: cached pages, chunks, facts, and what can be asked of them. An embedder and a judge for
    reranking are optional; so is a model for questions of finance."""

    def __init__(
        self, spark: SparkSession, folder: str, make_extractor: Callable[[], files.Extractor] = lambda: files.plain_text, make_embedder: Callable[[], retrieval.Embedder] | None = None,
        judge: Callable[[str, list[str]], list[float]] | None = None, **settings: object,
    ) -> None:
        self.spark, self.folder, self.make, self.make_embedder, self.judge = spark, folder, make_extractor, make_embedder, judge
        self.cache = stores.ParseCache(spark, f"{folder}/pages", ingest.fingerprint(**settings))
        self.chunks = stores.ChunkStore(spark, f"{folder}/chunks")
        self.accounts = stores.ChunkStore(spark, f"{folder}/facts/accounts")
        self.returns = stores.ChunkStore(spark, f"{folder}/facts/returns")

    def ingest(self, *paths: str, doc_type: str | None = None, force: bool = False) -> DataFrame:
        """Parse, chunk and store what is new, with its facts; the report has one row a file: name, doc_id, status,
        error, pages.

        Repeated content is skipped, as are indexed documents unless ``force``; only whole parses are cached.
        """
        found = files.discover(self.spark, *paths).withColumn("pos", F.monotonically_increasing_id())
        listed = checkpoint(ingest.duplicates(found.drop("content")))
        fresh = listed.where("status = 'new'").select("doc_id", "name")
        stored = self.chunks.read()
        if stored is not None and not force:
            fresh = ingest.new_documents(fresh, stored)
        todo = found.join(self.cache.missing(fresh).select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        parsed = checkpoint(files.extract(todo, self.make))
        outcome = parsed.groupBy("doc_id").agg(F.count("page_no").alias("pages"), F.max("error").alias("problem")).withColumn("cached", (F.col("pages") > 0) & F.col("problem").isNull())
        self.cache.put(parsed.where("page_no is not null").select("doc_id", "page_no", "md"), outcome)
        cached = self.cache.pages()
        pages = parsed.where("page_no is not null").select("doc_id", "page_no", "md")
        if cached is not None:
            pages = pages.unionByName(cached.select("doc_id", "page_no", "md")).distinct().join(fresh, "doc_id", "left_semi")
        pages = checkpoint(pages)
        if not pages.isEmpty():
            tagged = text.chunks(text.blocks(pages)).join(fresh.withColumnRenamed("name", "source"), "doc_id")
            dims = listing.doc_types(self.spark)
            kind = doc_type or "other"
            category = next((r.category for r in dims.where(F.col("key") == kind).collect()), "other")
            lines = checkpoint(facts.distinct_lines(numbered_lines(pages)))
            tagged = listing.tagged_chunks(tagged, facts.sections(lines)).withColumnRenamed("section_account", "account")
            if self.make_embedder:
                tagged = retrieval.embedded(tagged, "text", self.make_embedder)
            self.chunks.upsert(tagged.withColumn("chunk_id", F.concat_ws(":", "doc_id", F.col("chunk_index").cast("string"))).withColumn("doc_type", F.lit(kind)).withColumn("category", F.lit(category)))
            names = fresh.withColumnRenamed("name", "source")
            for store, rows in ((self.accounts, facts.statement_facts(lines)), (self.returns, facts.returns(lines))):
                kept = checkpoint(rows.join(names, "doc_id"))
                if not kept.isEmpty():
                    store.upsert(kept)
        done = outcome.select("doc_id", "pages", "problem")
        status = F.when(F.col("status") == "skipped", "skipped").when(F.col("problem").isNotNull() & (F.col("pages") == 0), "failed").when(F.col("problem").isNotNull(), "partial").when(F.col("pages").isNotNull(), "done").otherwise("skipped")
        return listed.join(done, "doc_id", "left").select("name", "doc_id", status.alias("status"), F.coalesce("error", "problem").alias("error"), F.coalesce("pages", F.lit(0)).alias("pages"))

    def pages(self) -> DataFrame | None:
        return self.cache.pages()

    def listing(self) -> DataFrame | None:
        """Stored documents."""
        c = self.chunks.read()
        return None if c is None else listing.documents(c)

    def instant(self, question: str, category: str | None = None, doc_id: str | None = None, year: str | None = None) -> list[str]:
        """Answers from stored facts alone, one a document in scope (all of them, or ``doc_id``); none where
        the question needs a model or names nothing of facts, nor for a category other than finance."""
        if category not in (None, "", "all", "finance"):
            return []
        q = F.lit(question)
        asked = self.spark.range(1).select(answers.intent(q).alias("i"), *(w.alias(n) for w, n in zip(answers.wants(q), ("debits", "credits"), strict=True)), answers.year_asked(q, F.lit(year)).alias("year")).first()
        tables = []
        accounts, returns = self.accounts.read(), self.returns.read()
        in_scope = lambda d: d.where(F.col("doc_id") == doc_id) if doc_id else d
        if asked["i"] in ("bank", "both") and accounts is not None:
            tables.append(answers.bank_answers(in_scope(accounts), debits=asked["debits"], credits=asked["credits"]))
        if asked["i"] in ("tax", "both") and returns is not None:
            tables.append(answers.return_answers(in_scope(returns), asked["year"]))
        return [r["answer"] for t in tables for r in t.orderBy("doc_id").toLocalIterator()]

    def fact_block(self, doc_ids: list[str], year: str | None = None) -> str:
        """The facts of the first documents of a prompt, as text."""
        wanted = list(dict.fromkeys(d for d in doc_ids if d))[:FACT_DOCS]
        texts: dict[str, list[str]] = {}
        for store, render in ((self.returns, lambda d, n: answers.rendered_returns(d, n, year)), (self.accounts, answers.rendered_accounts)):
            d = store.read()
            if d is not None and wanted:
                own = d.where(F.col("doc_id").isin(wanted))
                for r in render(own.drop("source"), own.groupBy("doc_id").agg(F.min("source").alias("source"))).collect():  # at most three documents
                    texts.setdefault(r["doc_id"], []).append(r["text"])
        return "\n".join(t for d in wanted for t in texts.get(d, []) if t)

    def retrieve(self, question: str, k: int = TOP_K, **filters: str | None) -> DataFrame | None:
        """The best passages in order, with their citation labels; the judge, if there is one, orders the
        candidates anew."""
        stored = self.chunks.read()
        if stored is None:
            return None
        how = {"vector": "embedding", "query_vector": self.make_embedder().query(question)} if self.make_embedder else {}
        hits = checkpoint(retrieval.hybrid(stored, question, k * retrieval.CANDIDATES if self.judge else k, retrieval.where(**filters), **how))
        if self.judge:
            hits = checkpoint(retrieval.reranked(hits, question, self.judge, k))
        return hits.withColumn("label", retrieval.source_label(F.col("source"), F.col("page_start"), F.col("page_end"), F.col("account"), F.col("heading_path")))

    def ask(self, question: str, model: ChatModel | None = None, k: int = TOP_K, model_only: bool = False, finance_model: ChatModel | None = None, year: str | None = None, **filters: str | None) -> Iterator[dict]:
        """Events of an answer: ``prepared``, ``token`` for each piece, ``answer`` with sources and the
        figures that no source holds. A question of facts is answered at once unless ``model_only``; else the facts of
        the first documents stand before the passages, which share the budget with them."""
        if not model_only and (quick := self.instant(question, filters.get("category"), filters.get("doc_id"), year)):
            yield {"event": "answer", "text": "\n\n---\n\n".join(quick) + NOTE, "sources": [], "unverified": [], "route": "facts"}
            return
        found = self.retrieve(question, k, **filters)
        ranked = [] if found is None else found.orderBy(F.desc("score"), "chunk_id").select("doc_id").collect()  # k rows
        if not ranked:
            yield {"event": "answer", "text": NOTHING, "sources": [], "unverified": [], "route": "none"}
            return
        own = self.fact_block([filters["doc_id"]] if filters.get("doc_id") else [r["doc_id"] for r in ranked], year)
        frame = lambda t: self.spark.createDataFrame([(1, t)], "k int, text string")
        spent = frame(own).select(est_tokens("text").alias("n")).first()["n"] if own else 0
        hits = retrieval.budget_cut(found, [], [F.desc("score"), F.col("chunk_id")], "text", CONTEXT - int(spent)).orderBy("rn").collect()
        finance = filters.get("category") == "finance" or (filters.get("category") in (None, "", "all") and hits[0]["category"] == "finance")
        passages = "\n\n".join(f"[{n}] {h.label}\n{h.text}" for n, h in enumerate(hits, 1))
        context = f"{FACTS_MARK}\n{own}\n\n---\n\n{passages}" if own else passages
        route = "finance" if finance else "general"
        yield {"event": "prepared", "passages": len(hits), "tokens": int(sum(h.cost for h in hits) + spent), "route": route}
        said: list[str] = []
        chosen = finance_model if finance and finance_model else model
        for piece in chosen([("system", RULES), ("user", f"{context}\n\nQuestion: {question}")]) if chosen else iter(()):
            said.append(piece)
            yield {"event": "token", "text": piece}
        whole = "".join(said) or passages
        flagged = [r.raw.strip() for r in grounding.unverified(frame(whole), frame(context), "k").orderBy("pos").collect()]
        yield {"event": "answer", "text": whole, "sources": [h.label for h in hits], "unverified": flagged, "route": route}
