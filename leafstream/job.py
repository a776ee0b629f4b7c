"""A job: files in, rendered files out, with a checkpoint between runs.

    files -> segments -> lookup in the checkpoint -> chunks -> waves of calls, each kept -> merge -> rebuilt files

Every arrow is a DataFrame; the only barriers are the dispatcher's waves.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafstream.functions.text import is_translatable, output_name
from leafstream.operators import cache, chunking, layouts, segmentation
from leafstream.operators.dispatch import Call, Dispatch, Provider, Run, Settings, hashed_results
from leafstream.sources import files as sources
from leafstream.sources.shared import Scope, settle, shared_folder

#: Parts that are shown of a running job, and the characters shown of each.
SHOWN, SHOWN_CHARS = 5, 6000


class Job:
    """One run over the files of `files` (see :func:`leafstream.sources.files.read_files`).

    With `watched`, the last parts of each wave are kept for :meth:`progress`.
    """

    def __init__(
        self,
        files: DataFrame,
        providers: list[Provider],
        call: Call,
        settings: Settings = Settings(),
        checkpoint: str | None = None,
        pages: DataFrame | None = None,
        more_providers: Callable[[], list[Provider]] | None = None,
        log: Callable[[str], None] = lambda line: None,
        watched: bool = False,
    ):
        self.spark: SparkSession = files.sparkSession
        self.files = files
        self.providers, self.call, self.settings = providers, call, settings
        self.checkpoint = checkpoint
        self.pages = pages
        self.more_providers, self.log, self.watched = more_providers, log, watched
        self._cancelled = False
        self._state = "pending"
        self.error = ""
        self.recent: list[dict] = []
        self.run_result: Run | None = None
        self._dispatch: Dispatch | None = None
        self._scope = Scope(self.spark)
        self._sums = {"total_segments": 0, "total_chars": 0, "resumed_segments": 0, "resumed_chars": 0}

    @property
    def state(self) -> str:
        """pending, running, waiting (for a service), done, cancelled, stopped or error."""
        told = self._dispatch.state if self._dispatch else ""
        return "waiting" if self._state == "running" and told == "waiting" else self._state

    @state.setter
    def state(self, value: str) -> None:
        self._state = value

    def cancel(self) -> None:
        """Stops before the next wave, or within a second of waiting; what is done is in the checkpoint."""
        self._cancelled = True

    # ---- reading -------------------------------------------------------------------------------------------

    @cached_property
    def _layouts(self) -> DataFrame:
        """(doc_id, ext, layout) of plain texts and subtitles, parsed once for the segments and for the build."""
        texts = sources.texts(self.files)
        plain = segmentation.text_layouts(texts.where("ext <> '.srt'")).withColumn("ext", F.lit(".txt"))
        cues = segmentation.subtitle_layouts(texts.where("ext = '.srt'")).withColumn("ext", F.lit(".srt"))
        return settle(plain.unionByName(cues), "layouts")

    @cached_property
    def _blocks(self) -> DataFrame:
        return settle(sources.blocks(self.files), "blocks")

    @cached_property
    def _has_pages(self) -> bool:
        return self.pages is not None or not self.files.where("ext = '.pdf'").isEmpty()

    @cached_property
    def _page_texts(self) -> DataFrame:
        return settle(sources.pdf_pages(self.files), "pages") if self.pages is None else self.pages

    @cached_property
    def _page_items(self) -> DataFrame:
        """(doc_id, page_no, item_no, raw, pieces, first): the paragraphs of pages; `pieces` is null for what stays,
        `first` the number of an item's first piece in its document."""
        pages = self._page_texts.where("page_no IS NOT NULL")
        paragraphs = pages.select("doc_id", "page_no", segmentation.page_paragraphs(F.col("text")).alias("paragraphs"))
        kept = segmentation.drop_running_headers(paragraphs)
        rows = kept.select("doc_id", "page_no", F.posexplode("paragraphs").alias("item_no", "raw"))
        pieces = F.when(is_translatable(F.col("raw")), segmentation.split_long(F.col("raw"), segmentation.PARAGRAPH))
        before = Window.partitionBy("doc_id").orderBy("page_no", "item_no").rowsBetween(Window.unboundedPreceding, -1)
        first = F.coalesce(F.sum(F.coalesce(F.size("pieces"), F.lit(0))).over(before), F.lit(0))
        return settle(rows.withColumn("pieces", pieces).withColumn("first", first), "page-items")

    def _page_pieces(self) -> DataFrame:
        """(doc_id, page_no, item_no, piece_no, seg_id, text) of the paragraphs of pages."""
        rows = self._page_items.where("pieces IS NOT NULL").select("doc_id", "page_no", "item_no", "first", F.posexplode("pieces").alias("piece_no", "text"))
        return rows.select("doc_id", "page_no", "item_no", "piece_no", (F.col("first") + F.col("piece_no")).cast("int").alias("seg_id"), "text")

    def segments(self) -> DataFrame:
        """(doc_id, seg_id, text): the segments of all files."""
        blocks = self._blocks.where("problem IS NULL").select("doc_id", "seg_id", "text")
        found = segmentation.segments_of(self._layouts).unionByName(blocks)
        return found.unionByName(self._page_pieces().select("doc_id", "seg_id", "text")) if self._has_pages else found

    def problems(self) -> DataFrame:
        """(doc_id, problem): the files that can't be read, or whose format is none of those known."""
        found = self._blocks.where("problem IS NOT NULL").select("doc_id", "problem")
        if self._has_pages and self.pages is None:
            found = found.unionByName(self._page_texts.where("problem IS NOT NULL").select("doc_id", "problem"))
        return found.unionByName(self.files.where("ext IS NULL").select("doc_id", F.lit("unknown format").alias("problem")))

    # ---- running -------------------------------------------------------------------------------------------

    def run(self) -> DataFrame:
        """(doc_id, filename, output, content): the rebuilt files. Segments that were given up keep their text; a file
        that can't be read is not among them, but among :meth:`problems`."""
        with self._scope:
            return self._run()

    def close(self) -> None:
        """Deletes the job's tables, its built files among them: for when these have been delivered."""
        self._scope.close()

    def _run(self) -> DataFrame:
        self.state = "running"
        hashes = self.files.select("doc_id", "file_hash")
        self._found = settle(self.segments().join(hashes, "doc_id").withColumn("mode", F.lit(self.settings.mode)), "segments")
        entries = settle(cache.read(self.spark, self.checkpoint), "checkpoint") if self.checkpoint else None
        remaining = self._found if entries is None else cache.pending(self._found, entries)
        remaining = settle(remaining.select("doc_id", "seg_id", "text"), "remaining")
        self._count(remaining)
        plan = chunking.make_chunks(remaining, limit=self.settings.max_chars)
        chunks = chunking.assemble(plan).join(hashes, "doc_id")
        self._dispatch = Dispatch(
            chunks, self.providers, self.call, self.settings, self.more_providers, self._keep, lambda: self._cancelled, log=self.log
        )
        self.run_result = self._dispatch.run()
        self.providers = self._dispatch.providers
        results = self.run_result.results.select("doc_id", "seg_id", "translation")
        if entries is not None:
            old = cache.lookup(self._found, entries).where("translation IS NOT NULL").select("doc_id", "seg_id", "translation")
            results = cache.merge(old, results, ["doc_id", "seg_id"])
        built = settle(self._build(settle(results, "results")), "built")
        self.state = "cancelled" if self._cancelled else "stopped" if self.run_result.stopped else "done"
        return built

    def _count(self, remaining: DataFrame) -> None:
        sums = [d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("c")).first() for d in (self._found, remaining)]
        (n, chars), (left, left_chars) = ((r["n"], r["c"] or 0) for r in sums)
        self._sums = {"total_segments": n, "total_chars": chars, "resumed_segments": n - left, "resumed_chars": chars - left_chars}
        self.log(f"{n} segments" + (f", {n - left} of them in the checkpoint" if n > left else ""))

    def _keep(self, wave: int, outcomes: DataFrame) -> None:
        """Adds a wave's results to the checkpoint."""
        if self.checkpoint:
            cache.write(hashed_results(outcomes, self.settings.mode), self.checkpoint)
        if self.watched:
            clip = lambda c: F.left(F.array_join(c, "\n\n"), F.lit(SHOWN_CHARS)).alias("source" if c == "texts" else "translation")
            last = outcomes.where("state = 'done'").orderBy(F.col("at").desc()).limit(SHOWN).select("chunk_id", "provider", "at", clip("texts"), clip("parsed"))
            self.recent = ([r.asDict() for r in last.collect()] + self.recent)[:SHOWN]

    def _build(self, results: DataFrame) -> DataFrame:
        plain = layouts.build_text(self._layouts.where("ext = '.txt'"), results)
        subtitles = layouts.build_subtitles(self._layouts.where("ext = '.srt'"), results)
        whole = plain.unionByName(subtitles).select("doc_id", F.encode("text", "UTF-8").alias("content"))
        whole = whole.unionByName(sources.rebuild(self.files, results))
        if self._has_pages:
            whole = whole.unionByName(self._built_pages(results))
        ext = F.col("ext")
        out = F.coalesce(*[F.when(ext == a, F.lit(b)) for a, b in sources.OUTPUTS.items()], ext)
        named = self.files.select("doc_id", "filename", output_name(F.col("filename"), F.lit(self.settings.mode), out).alias("output"))
        return named.join(whole.where("content IS NOT NULL"), "doc_id")

    def _built_pages(self, results: DataFrame) -> DataFrame:
        pieces = layouts.rendered(self._page_pieces(), results)
        done = pieces.groupBy("doc_id", "page_no", "item_no").agg(F.array_sort(F.collect_list(F.struct("piece_no", "text"))).alias("p"))
        joined = done.select("doc_id", "page_no", "item_no", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))
        raw = self._page_items.where("pieces IS NULL").select("doc_id", "page_no", "item_no", F.col("raw").alias("text"))
        return sources.pages_to_word(layouts.build_pages(joined.unionByName(raw)))

    def progress(self) -> dict:
        """The job's state, counts, speed, time left, services and last parts, while it runs and after, without a
        Spark job; `percent` is of characters."""
        told = self._dispatch.progress() if self._dispatch else {}
        done = self._sums["resumed_chars"] + told.get("done_chars", 0)
        total = self._sums["total_chars"]
        percent = 100.0 if self.state == "done" else round(min(100.0, 100 * done / total), 1) if total else 0.0
        return told | self._sums | {
            "status": self.state,
            "error": self.error,
            "done_segments": self._sums["resumed_segments"] + told.get("done_segments", 0),
            "failed_segments": told.get("failed_segments", 0),
            "done_chars": done,
            "percent": percent,
            "rounds": told.get("wave", 0),
            "recent": self.recent,
        }


def default_checkpoint(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/leafstream/checkpoint"
