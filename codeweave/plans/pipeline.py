"""The commands: generate, update, plan, validate.

Stages that only derive tables are lazy plans; those that ask a completion service are barriers.
What they hand on is written as artifacts, so an interrupted run resumes from what is there.
"""

from __future__ import annotations

import logging
import os
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave import runtime
from codeweave.functions import pages, prompts, text
from codeweave.operators import changes, fanout, graph, integrity, links, resolve, schema, symbols
from codeweave.plans import planning, summaries
from codeweave.sources import artifacts, registry, tree
from codeweave.sources.client import Client
from codeweave.sources.config import Config

log = logging.getLogger("codeweave")


class MissingDocument(FileNotFoundError):
    """A module that is not shared has no page."""


@contextmanager
def phase(name: str) -> Iterator[None]:
    began = time.monotonic()
    log.debug("phase %s starts", name)
    yield
    log.debug("phase %s took %d ms", name, (time.monotonic() - began) * 1000)


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


class Run:
    """One repository, its configuration and its artifacts."""

    def __init__(self, spark: SparkSession, config: Config, client: Client | None = None, computed_plan: bool = False) -> None:
        self.spark, self.config, self.client = spark, config, client
        self.computed_plan = computed_plan or client is None
        self.store = artifacts.Artifacts(spark, config.artifacts_dir)
        self.skipped = 0

    # -- tables -------------------------------------------------------------------------------

    def scan(self) -> DataFrame:
        """The file index of the tree, imports resolved; files that do not parse are counted and left out."""
        root, exclude = self.config.repo_path, self.config.analysis.exclude_patterns
        module = tree.module_name(root)
        parsed = runtime.stage(registry.parse_files(tree.read_tree(self.spark, root, exclude)), "parsed")
        self.skipped = registry.skipped(parsed)
        return self.resolved(registry.index_of(parsed), module)

    def resolved(self, index: DataFrame, module: str | None = None) -> DataFrame:
        every = tree.read_tree(self.spark, self.config.repo_path, contents=False).select("path")
        index = resolve.resolve_imports(index, every, module or tree.module_name(self.config.repo_path))
        return resolve.check_resolved(runtime.stage(index, "index"))

    def save_index(self, index: DataFrame) -> None:
        self.store.write_file_index(index)
        self.store.write_dep_graph(graph.adjacency(index, resolve.edges_of(index)))

    def _request(self, model: str) -> dict:
        return {"model": model, "max_tokens": self.config.llm.max_tokens, "temperature": self.config.llm.temperature}

    # -- phases -------------------------------------------------------------------------------

    def analyse(self) -> DataFrame:
        index = self.scan()
        self.save_index(index)
        return index

    def make_plan(self, index: DataFrame) -> DataFrame:
        """Asked of the client, or computed from the file graph."""
        threshold = self.config.analysis.shared_module_threshold
        if self.computed_plan:
            rows = planning.computed_plan(index, resolve.edges_of(index), threshold).orderBy("id").toLocalIterator()
            modules = [r.asDict() for r in rows]
        else:
            modules = planning.ask_plan(index, self.client, self.config.agent.skeleton_max_tokens, threshold, **self._request(self.config.llm.planner_model))
        self.store.write_nav_plan(modules, _now())
        return self.store.read_nav_plan()

    def share(self, modules: DataFrame, index: DataFrame, edges: DataFrame, affected: DataFrame | None = None) -> DataFrame:
        existing = self.store.read_shared_context() if affected is not None and self.store.has(artifacts.SHARED_CONTEXT) else None
        context = summaries.summarise(
            modules, index, edges, self.client, self.config.agent.skeleton_max_tokens,
            self._request(self.config.llm.preprocessor_model or self.config.llm.planner_model), self.config.agent.concurrency,
            None if affected is None else affected.select(F.col("id").alias("module_id")), existing,
        )
        if context.isEmpty():
            return context  # nothing is shared, and nothing is written
        page = pages.shared_page(F.col("module_id"), F.col("summary"), F.col("key_types"), F.col("key_functions"), F.col("source_refs"))
        self.store.write_module_docs(context.select("module_id", page.alias("content")))
        self.store.write_shared_context(context)
        return context

    def document(self, modules: DataFrame, index: DataFrame, context: DataFrame) -> DataFrame:
        """A page for every module that the agents own; pages of those that worked are kept when others fail."""
        own = modules.where(F.col("owner") == schema.AGENT)
        texts = summaries.module_skeletons(own, index, self.config.agent.skeleton_max_tokens)
        block = prompts.shared_block(own, context).withColumnRenamed("id", "module_id")
        asked = texts.join(block, "module_id", "left").select(
            "module_id", F.lit(self.config.llm.agent_model).alias("model"), F.lit("").alias("system"),
            prompts.agent(F.col("module_id"), F.col("skeleton"), F.col("block")).alias("user"),
            F.lit(self.config.llm.max_tokens).alias("max_tokens"), F.lit(0.0).cast("float").alias("temperature"),
        )
        got = fanout.run(asked, self.client, self.config.agent.concurrency)
        self.store.write_module_docs(got)
        fanout.raise_failures(got)
        return got

    def compose(self, modules: DataFrame, index: DataFrame, edges: DataFrame, compat_depth: bool = False) -> dict:
        """Pages with citations and contents, the index page, the link report, the site's files."""
        out = self.config.output_dir
        docs = modules.select("id", "shared").join(self.store.read_module_docs().withColumnRenamed("module_id", "id"), "id", "left")
        absent = docs.where("content is null and not shared").orderBy("id").first()
        if absent:
            raise MissingDocument(f"module {absent['id']} has no page")
        cited = symbols.inject_citations(docs.where("content is not null"), "id", "content", symbols.symbol_map(symbols.declarations(index)))
        folder = F.when(F.col("shared"), F.lit("shared/")).otherwise(F.lit("modules/"))
        artifacts.write_texts(cited.select(F.concat(folder, F.col("id"), F.lit(".md")).alias("path"), text.with_toc(F.col("content")).alias("content")), out)
        depth = None if compat_depth else graph.depths(modules.select(F.col("id").alias("node")), graph.contract(edges, modules, only_shared=False))
        artifacts.write_texts(self.spark.createDataFrame([("index.md", pages.index_page(modules, depth))], schema.DOCS), out)
        report = self.validate()
        site = self.config.site
        pages.write_assets(out, pages.site_config(modules, site.title, self.config.repo_path, site.repo_url), site.logo)
        return report

    # -- commands -----------------------------------------------------------------------------

    def plan(self) -> DataFrame:
        with phase("analysis"):
            index = self.analyse()
        with phase("planning"):
            return self.make_plan(index)

    def generate(self) -> dict:
        """A full build; an existing plan and shared context are used again, and a plan that no longer
        fits the tree is warned about."""
        with phase("analysis"):
            index = self.analyse()
        edges = runtime.stage(resolve.edges_of(index), "edges")
        if self.store.has(artifacts.NAV_PLAN) and self.store.has(artifacts.SHARED_CONTEXT):
            modules, context = self.store.read_nav_plan(), self.store.read_shared_context()
            stale = integrity.first_violation(integrity.violations(modules, index)).first()
            if stale:
                log.warning("the stored plan does not fit the tree: %s", integrity.message(stale))
        else:
            with phase("planning"):
                modules = self.make_plan(index)
            with phase("shared modules"):
                context = self.share(modules, index, edges)
        with phase("modules"):
            self.document(modules, index, context)
        with phase("composition"):
            return self.compose(modules, index, edges)

    def update(self, changed_files: str = "", base: str = "", head: str = "", include_old_path: bool = False) -> dict:
        """Redo what a change reaches; without an index, a full build."""
        if not self.store.has(artifacts.FILE_INDEX):
            return self.generate()
        index = self.resolved(self.store.read_file_index())
        modules = self.store.read_nav_plan()
        if changed_files:
            changed = changes.parse_changed_literal(self.spark, changed_files)
        else:
            changed = changes.changed_files(*tree.revisions(self.spark, self.config.repo_path, base, head))
        changed = runtime.stage(changed, "changes")
        if not changed.where("type <> 'deleted'").isEmpty():
            index = runtime.stage(changes.upsert(index, self.scan(), changed), "index")
        else:
            index = runtime.stage(changes.upsert(index, index.limit(0), changed), "index")
        self.save_index(index)
        edges = runtime.stage(resolve.edges_of(index), "edges")
        hit = runtime.stage(graph.affected(changed, modules, edges, include_old_path), "affected")
        touched = hit.where(F.col("shared") | (F.col("owner") == schema.PREPROCESSOR))
        context = self.share(modules, index, edges, touched)
        if not hit.isEmpty():
            self.document(hit, index, context)
        return self.compose(modules, index, edges)

    def validate(self) -> dict:
        """The link report of the output folder; broken links are reported, not raised."""
        out = self.config.output_dir
        os.makedirs(out, exist_ok=True)
        files = tree.read_tree(self.spark, out).select("path", F.col("content").cast("string").alias("content"))
        gone, totals = links.report(files)
        return self.store.write_report(gone, totals, _now())


