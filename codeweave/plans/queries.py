"""The operators applied to the driver's tables.

The tables hold no source trees, so each query maps whole tables onto the data model by plain
expressions (a document is a file, its source a module, a supplier a node) and applies the operator
to the result.  ``codeweave.plans.oracle`` has the same mapping in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave import runtime
from codeweave.functions import globs, pages, prompts, text
from codeweave.functions.strict_json import replies
from codeweave.operators import changes, fanout, graph, integrity, links, resolve, schema, skeleton, symbols
from codeweave.sources import registry
from codeweave.sources.client import CompletionError, Offline

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

GLOBS = ["*.example.net/en/*", "**/fr/**", "m.*/**", "*[0-3]", "{blog,www}.tion*/*/?"]
BUDGET_FILL, BUDGET_CUT = 60, 200


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def _path_of_url() -> Column:
    return F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")


# -- links ------------------------------------------------------------------------------------


def _page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown files: anchors become Markdown links."""
    md = F.regexp_replace("html", '<a href="([^"]+)">([^<]+)</a>', "[$2]($1)")
    return _table(spark, sf_dir, "pages").select("page_id", F.concat(_path_of_url(), F.lit(".md")).alias("path"), md.alias("content"))


@query
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone, _ = links.report(_page_files(spark, sf_dir))
    return gone


@query
def link_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, totals = links.report(_page_files(spark, sf_dir))
    return totals


@query
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.internal_links(_page_files(spark, sf_dir))


@query
def exclude_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _table(spark, sf_dir, "pages").select("page_id", _path_of_url().alias("path"))
    return paths.where(~globs.matches(F.col("path"), GLOBS))


# -- scalars ----------------------------------------------------------------------------------


@query
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


@query
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", text.token_estimate(t).alias("estimate"), text.token_estimate_up(t).alias("estimate_up"))


@query
def line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("line_no", "line"))
    return docs.select("doc_id", (F.col("line_no") + 1).alias("line_no"), F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query
def heading_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return _table(spark, sf_dir, "pages").select("page_id", title.alias("title"), text.slug(title).alias("slug"))


def _headed(docs: DataFrame) -> DataFrame:
    """Documents whose second line is a title and of whose other lines every fifth is a heading."""
    mark = lambda x, i: (
        F.when(i == 1, F.concat(F.lit("# "), x)).when(i % 5 == 2, F.concat(F.lit("## "), x)).when(i % 5 == 4, F.concat(F.lit("### "), x)).otherwise(x)
    )
    return docs.select("doc_id", F.array_join(F.transform(text.lines(F.col("text")), mark), "\n").alias("body"))


@query
def toc_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _headed(_table(spark, sf_dir, "documents"))
    body = F.col("body")
    return docs.select("doc_id", F.array_join(text.toc_entries(body), "\n").alias("entries"), F.md5(text.with_toc(body).cast("binary")).alias("page_md5"))


@query
def parse_changed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    csv = F.concat(F.lit(" , "), F.array_join("names", " ,\t"), F.lit(",, "))
    return changes.parse_changed(nations.select(csv.alias("csv")))


@query
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = replies(_table(spark, sf_dir, "events"), "event_id", "props", {"k": int}, "struct<k:bigint>")
    return got.select("event_id", "value.k")


@query
def strict_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as replies: fenced, with words before a fence, with trailing text, with another type."""
    how = F.col("event_id") % 4
    reply = (
        F.when(how == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(how == 1, F.concat("props", F.lit(" and more")))
        .when(how == 2, F.concat(F.lit("Here: ```"), F.regexp_replace("props", '"k"', '"K"'), F.lit("```"))).otherwise(F.regexp_replace("props", "([0-9]+)", '"$1"'))
    )
    got = replies(_table(spark, sf_dir, "events").select("event_id", reply.alias("reply")), "event_id", "reply", {"k": int}, "struct<k:bigint>")
    return got.select("event_id", "value.k", F.col("problem").isNotNull().alias("refused"))


# -- symbols ----------------------------------------------------------------------------------


def _names(c: str = "text") -> Column:
    """Capitalised ASCII words, in order."""
    return F.regexp_extract_all(c, F.lit("([A-Z][a-z]+)"), F.lit(1))


@query
def symbol_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    declared = docs.select(
        F.col("text").alias("name"), F.col("source").alias("path"), F.lit(0).alias("kind_ord"), F.col("doc_id").alias("line_start"),
        text.is_exported(F.col("text")).alias("exported"),
    )
    return symbols.symbol_map(declared).select(F.md5(F.col("name").cast("binary")).alias("name_md5"), "ref")


def _word_symbols(docs: DataFrame) -> DataFrame:
    """Names that English documents hold; others stay without a reference."""
    declared = docs.where("lang = 'en'").select(F.explode(F.array_distinct(_names())).alias("name"), F.col("source").alias("path"), F.lit(0).alias("kind_ord"), F.col("doc_id").alias("line_start"))
    return symbols.symbol_map(declared.withColumn("exported", F.lit(True)))


@query
def citation_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    cited = docs.select("doc_id", F.regexp_replace("text", "([A-Z][a-z]+)", "`$1`").alias("body"))
    out = symbols.inject_citations(cited, "doc_id", "body", _word_symbols(docs))
    return out.select("doc_id", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query
def ground_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, talk = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "conversations")
    declared = docs.select(F.col("source").alias("path"), F.col("doc_id").alias("ord"), F.explode(F.array_distinct(_names())).alias("name"), F.col("lang").alias("signature"), F.col("n_chars").alias("line_start"))
    claims = talk.select("conv_id", "turn", "role", F.posexplode(_names()).alias("pos", "name")).select(
        F.lit("all").alias("module_id"), ((F.col("conv_id") * 1000 + F.col("turn")) * 10000 + F.col("pos")).alias("ord"), "name",
        F.when(F.col("role") == "user", F.lit("")).otherwise(F.lit("en")).alias("signature"), F.lit("claimed").alias("ref"),
    )
    files = docs.select(F.lit("all").alias("module_id"), F.col("source").alias("path"))
    return symbols.ground(claims, declared, files).select("ord", "name", "ref", "grounded")


@query
def go_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a Go file that has all of its lines as comments."""
    return _go_index(spark, sf_dir, F.array_join(F.transform(F.split(F.regexp_replace("text", "\r", ""), "\n"), lambda x: F.concat(F.lit("// "), x)), "\n"))


def _go_index(spark: SparkSession, sf_dir: str, comment: Column) -> DataFrame:
    i = F.col("doc_id").cast("string")
    source = F.concat(
        F.lit("package p\n\nimport \"fmt\"\n\n"), comment, F.lit("\ntype T"), i, F.lit(" struct {\n\tx int\n}\n\nfunc (t *T"), i, F.lit(") F"), i,
        F.lit("(a int) error {\n\treturn nil\n}\n\nfunc g(b string) {}\n"),
    )
    files = _table(spark, sf_dir, "documents").select(_id("d", "doc_id").alias("p"), source.cast("binary").alias("content")).select(F.concat("p", F.lit(".go")).alias("path"), "content")
    index = registry.index_of(registry.parse_files(files))
    return index.select(
        "path", "content_hash", F.array_join(F.transform("functions", lambda f: F.concat_ws("|", f["name"], f["signature"], f["line_start"], f["line_end"], f["exported"])), ";").alias("functions"),
        F.array_join(F.transform("types", lambda t: F.concat_ws("|", t["name"], t["kind"], t["line_start"], t["line_end"])), ";").alias("types"),
        F.array_join(F.transform("imports", lambda x: x["path"]), ";").alias("imports"),
    )


def _prose_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a file index: a line is a function, the language a type."""
    shown = lambda x: text.is_exported(x)
    lines = F.transform(text.lines(F.col("text")), lambda x, i: F.struct(
        x.alias("name"), F.concat(F.lit("func "), x).alias("signature"), (i + 1).alias("line_start"), (i + 1).alias("line_end"), shown(x).alias("exported")
    ))
    kind = F.struct(F.col("lang").alias("name"), F.lit("struct").alias("kind"), F.col("n_chars").cast("int").alias("line_start"), F.col("n_chars").cast("int").alias("line_end"), (F.col("doc_id") % 2 == 0).alias("exported"))
    return _table(spark, sf_dir, "documents").select(_id("d", "doc_id").alias("path"), lines.alias("functions"), F.array(kind).alias("types"))


@query
def skeleton_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = skeleton.lines_of(_prose_index(spark, sf_dir))
    return lines.select("path", "part", "ord", F.md5(F.col("line").cast("binary")).alias("line_md5"), "always")


@query
def declared_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = symbols.declarations(_prose_index(spark, sf_dir))
    return found.select(F.md5(F.col("name").cast("binary")).alias("name_md5"), "path", "kind_ord", "line_start", "exported")


# -- graphs -----------------------------------------------------------------------------------


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files that import suppliers: a file, a package, a path that only begins like the module, a lost one."""
    s = _table(spark, sf_dir, "supplier")
    folder, file = _id("nation", "s_nationkey"), _id("s", "s_suppkey")
    listing = s.select(F.concat(folder, F.lit("/"), file, F.when(F.col("s_suppkey") % 5 == 0, F.lit(".md")).otherwise(F.lit(".go"))).alias("path"))
    how = F.col("s_suppkey") % 4
    path = (
        F.when(how == 0, F.concat(F.lit("shop/"), folder, F.lit("/"), file)).when(how == 1, F.concat(F.lit("shop/"), folder))
        .when(how == 2, F.concat(F.lit("shopping/"), folder)).otherwise(F.concat(F.lit("shop/lost"), F.col("s_nationkey")))
    )
    used = _table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().join(s.select(F.col("s_suppkey").alias("l_suppkey"), path.alias("import")), "l_suppkey")
    one = lambda x: F.struct(x.alias("path"), F.lit(False).alias("internal"), F.lit("").alias("resolved_path"))
    index = used.groupBy(_id("p", "l_partkey").alias("path")).agg(F.transform(F.sort_array(F.collect_set("import")), one).alias("imports"))
    return resolve.resolve_imports(index, listing, "shop")


@query
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _resolved(spark, sf_dir).select("path", F.posexplode("imports").alias("pos", "i"))
    return got.select("path", "pos", F.col("i.path").alias("import"), F.col("i.internal").alias("internal"), F.col("i.resolved_path").alias("resolved_path"))


@query
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.edges_of(_resolved(spark, sf_dir)).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem")
    return items.select(_id("p", "l_partkey").alias("src"), _id("s", "l_suppkey").alias("dst")).distinct()


def _listed(lists: DataFrame) -> DataFrame:
    return lists.select("path", F.size("deps").alias("n_deps"), F.md5(F.array_join("deps", ",").cast("binary")).alias("deps_md5"))


@query
def dep_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _table(spark, sf_dir, "part").select(_id("p", "p_partkey").alias("path"))
    return _listed(graph.adjacency(nodes, _part_edges(spark, sf_dir)))


@query
def reverse_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _table(spark, sf_dir, "part").select(_id("p", "p_partkey").alias("path"))
    return _listed(graph.reverse_adjacency(nodes, _part_edges(spark, sf_dir)))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (src, dst) from customers and suppliers to nations to regions."""
    n, c, s = (_table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    up = n.select(_id("n", "n_nationkey").alias("src"), _id("r", "n_regionkey").alias("dst"))
    cs = c.select(_id("c", "c_custkey").alias("src"), _id("n", "c_nationkey").alias("dst"))
    return up.unionByName(cs).unionByName(s.select(_id("s", "s_suppkey").alias("src"), _id("n", "s_nationkey").alias("dst")))


def _module(df: DataFrame, id: Column, pos: Column, path: Column, shared: Column, owner: Column | None = None) -> DataFrame:
    """Modules of the rows of ``df``: files by group."""
    none = F.array().cast("array<string>")
    lists = df.groupBy(id.alias("id"), pos.cast("int").alias("pos"), shared.alias("shared")).agg(F.sort_array(F.collect_list(path)).alias("files"))
    owner = owner if owner is not None else F.when(F.col("shared"), schema.PREPROCESSOR).otherwise(schema.AGENT)
    return lists.select("id", "pos", "files", "shared", owner.alias("owner"), none.alias("depends_on_shared"), none.alias("referenced_by"))


@query
def affected_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of region 2 change; modules are regions (their nations) and market segments (their customers)."""
    n, c = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "customer")
    modules = _module(n, _id("region ", "n_regionkey"), F.col("n_regionkey"), _id("n", "n_nationkey"), F.lit(True)).unionByName(
        _module(c, F.concat(F.col("c_mktsegment"), F.lit(" "), F.col("c_nationkey")), 100 + F.col("c_nationkey"), _id("c", "c_custkey"), F.lit(False))
    )
    changed = n.where("n_regionkey = 2").select(_id("n", "n_nationkey").alias("path"), F.lit("").alias("old_path"), F.lit("modified").alias("type"))
    return graph.affected(changed, modules, _places(spark, sf_dir)).select("id", F.size("files").alias("n_files"))


def _supply_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "part")
    a = _module(s, _id("nation ", "s_nationkey"), F.col("s_nationkey"), _id("s", "s_suppkey"), F.lit(True))
    return a.unionByName(_module(p, F.col("p_brand"), F.lit(1000), _id("p", "p_partkey"), F.lit(True)))


@query
def module_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.contract(_part_edges(spark, sf_dir), _supply_modules(spark, sf_dir))


@query
def topo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of the contracted supply graph, whose size is that of the module list."""
    edges = runtime.stage(graph.contract(_part_edges(spark, sf_dir), _supply_modules(spark, sf_dir)), "module-edges")
    ids = [r[0] for r in _supply_modules(spark, sf_dir).select("id").toLocalIterator()]
    order = graph.topological_order(ids, [tuple(r) for r in edges.toLocalIterator()])
    return spark.createDataFrame(list(enumerate(order)), "pos int, id string")


@query
def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _places(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    return graph.topological_levels(nodes, edges)


@query
def dep_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _places(spark, sf_dir)
    return graph.depths(edges.select(F.col("src").alias("node")), edges).orderBy("depth", "node")


@query
def shared_by_indegree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.users_of(_part_edges(spark, sf_dir), 3)


# -- plans ------------------------------------------------------------------------------------


def _faulty_plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as an index, and a plan by source that lacks one language, assigns labelled documents
    twice, names files that do not exist, and repeats or lacks ids."""
    docs, labels, items = (_table(spark, sf_dir, t) for t in ("documents", "labels", "benchmark"))
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    owner = F.when(F.col("id") == "src3", "human").otherwise(schema.AGENT)
    plan = _module(docs.where("lang <> 'de'"), F.col("source"), number, _id("d", "doc_id"), F.lit(False), owner)
    plan = plan.unionByName(_module(labels, F.lit("labelled"), F.lit(1000), _id("d", "doc_id"), F.lit(True)))
    plan = plan.unionByName(_module(items, F.lit(""), F.lit(1001), _id("b", "item_id"), F.lit(False)))
    again = items.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    plan = plan.unionByName(_module(again, F.lit("labelled"), F.lit(1002), F.lit("b0"), F.lit(False)))
    return plan, docs.select(_id("d", "doc_id").alias("path"))


@query
def plan_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.violations(*_faulty_plan(spark, sf_dir))


@query
def first_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.first_violation(integrity.violations(*_faulty_plan(spark, sf_dir)))


# -- budgets ----------------------------------------------------------------------------------


@query
def skeleton_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document; those that start with an upper-case ASCII letter are always kept."""
    lines = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("scope"), F.posexplode(text.lines(F.col("text"))).alias("pos", "line"))
    kept = skeleton.fill(lines.withColumn("always", F.rlike("line", F.lit("^[A-Z]"))), BUDGET_FILL)
    return kept.select(F.col("scope").alias("doc_id"), "pos", "kept")


@query
def skeleton_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("scope"), "turn", F.col("text").alias("line"))
    return skeleton.cut(turns, BUDGET_CUT, ["turn"]).select(F.col("scope").alias("conv_id"), "turn", "estimate")


# -- changes ----------------------------------------------------------------------------------


@query
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events by type, in the first and in the second half of the month."""
    events = _table(spark, sf_dir, "events").withColumn("late", F.col("ts") >= F.lit("2024-01-16").cast("timestamp"))
    per = events.groupBy("late", F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("path"))
    state = per.agg(F.md5(F.count(F.lit(1)).cast("string").cast("binary")).alias("content_hash"))
    diff = changes.snapshot_diff(state.where("not late"), state.where("late"))
    return diff.select("path", "old_path", "type").orderBy("path", "old_path", "type")


@query
def rename_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of sources 1 to 9 move to another folder or get another name; copies make contents ambiguous."""
    base, head = _moves(spark, sf_dir, F.col("text"))
    return changes.renames(changes.snapshot_diff(base, head))


@query
def rename_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same moves, and two in three of the documents are edited on the way."""
    edited = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("\nmoved by "), F.col("doc_id").cast("string")))
    base, head = _moves(spark, sf_dir, edited)
    return changes.renames(changes.snapshot_diff(base, head), base, head)


def _moves(spark: SparkSession, sf_dir: str, after: Column) -> tuple[DataFrame, DataFrame]:
    """(path, content_hash, content) before and after; documents that stay keep path and text."""
    docs = _table(spark, sf_dir, "documents")
    i, near, far = F.col("doc_id").cast("string"), F.rlike("source", F.lit("^src[1-4]$")), F.rlike("source", F.lit("^src[5-9]$"))
    path = F.when(near, F.concat(F.lit("old/r"), i)).when(far, F.concat(F.lit("new/"), F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.lit("x")), i)).otherwise(F.concat(F.lit("old/"), i))
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    base = docs.select(F.concat(F.lit("old/"), i).alias("path"), hashed(F.col("text")).alias("content_hash"), F.col("text").alias("content"))
    text_after = F.when(near | far, after).otherwise(F.col("text"))
    return base, docs.select(path.alias("path"), hashed(text_after).alias("content_hash"), text_after.alias("content"))


@query
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as changes of documents: good ones are modified, toxic ones deleted, the rest renamed."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    hashed = lambda c: F.md5(c.cast("binary"))
    index = docs.select(_id("d", "doc_id").alias("path"), hashed(F.col("text")).alias("content_hash"))
    kind = F.when(F.col("toxic") == 1, "deleted").when(F.col("quality") == 1, "modified").otherwise("renamed")
    changed = labels.select(_id("d", "doc_id").alias("at"), kind.alias("type")).select(
        F.when(F.col("type") == "renamed", F.concat(F.lit("x"), "at")).otherwise(F.col("at")).alias("path"),
        F.when(F.col("type") == "renamed", F.col("at")).otherwise(F.lit("")).alias("old_path"), "type",
    )
    body = hashed(F.concat("text", F.lit("!")))
    fresh = docs.where("lang <> 'fr'").select(F.explode(F.array(_id("d", "doc_id"), _id("xd", "doc_id"))).alias("path"), body.alias("content_hash"))
    return changes.upsert(index, fresh, changed)


@query
def summary_carryover(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    existing = docs.where("lang = 'en'").select("doc_id", F.length("text").alias("size"))
    reuse, todo = changes.carry_over(existing, labels, labels.where("toxic = 1 or quality = 0"), "doc_id")
    return reuse.select("doc_id", "size", F.lit("kept").alias("state")).unionByName(todo.select("doc_id", F.lit(None).cast("int").alias("size"), F.lit("computed").alias("state")))


# -- pages and fan-out ------------------------------------------------------------------------


@query
def used_by_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    by = n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list("n_name")).alias("referenced_by"))
    shared = F.col("r_name") < "D"
    rows = r.join(by, "r_regionkey", "left").withColumn("referenced_by", F.coalesce("referenced_by", F.array().cast("array<string>")))
    return rows.select(F.col("r_name").alias("id"), pages.index_row(F.col("r_name"), shared, F.col("referenced_by")).alias("line"))


@query
def shared_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as summaries of shared modules; sections are empty for some."""
    i = F.col("doc_id")
    some = lambda c, x: F.when(c, F.array(*x)).otherwise(F.slice(F.array(*x), F.lit(1), F.lit(0)))
    f = F.struct(
        F.col("lang").alias("name"), F.when(i % 2 == 0, F.concat(F.lit("func "), "lang", F.lit("()"))).otherwise(F.lit("")).alias("signature"),
        F.when(i % 5 == 0, F.lit("")).otherwise(text.ref(F.col("source"), F.col("n_chars"))).alias("ref"),
    )
    page = pages.shared_page(_id("d", "doc_id"), F.col("text"), some(i % 3 != 0, [F.col("lang"), F.col("source")]), some(i % 12 != 0, [f]), some(i % 4 != 0, [F.col("source")]))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(page.cast("binary")).alias("page_md5"))


@query
def shared_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources depend on all of their documents; those with a label have a summary."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    names = F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: F.concat(F.lit("d"), x.cast("string")))
    modules = docs.groupBy(F.col("source").alias("id")).agg(names.alias("depends_on_shared"))
    f = F.array(F.struct(F.col("lang").alias("name")), F.struct(F.col("source").alias("name")))
    context = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).join(docs, "doc_id").select(
        _id("d", "doc_id").alias("module_id"), F.when(F.col("quality") == 1, F.col("text")).otherwise(F.lit("")).alias("summary"),
        F.when(F.col("toxic") == 0, f).otherwise(F.slice(f, F.lit(1), F.lit(0))).alias("key_functions"),
    )
    return prompts.shared_block(modules, context).select("id", F.md5(F.col("block").cast("binary")).alias("block_md5"))


_OFFLINE = Offline([("nicht", CompletionError("unavailable", 503, True)), ("éau", CompletionError("refused", 401))])


@query
def fanout_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn is a request; the offline client fails those that hold one of two strings."""
    talk = _table(spark, sf_dir, "conversations")
    asked = talk.select(
        F.concat_ws("/", F.col("conv_id"), F.col("turn")).alias("module_id"), F.lit("m").alias("model"), F.lit("").alias("system"),
        F.col("text").alias("user"), F.lit(100).alias("max_tokens"), F.lit(0.0).cast("float").alias("temperature"),
    )
    tally = fanout.tally(fanout.run(asked, _OFFLINE, 8))
    return tally.select("total", "succeeded", "failed", F.md5(F.col("failed_ids").cast("binary")).alias("failed_md5"))
