"""Pages of the documentation site: shared-module pages, the index page, the site's configuration."""

from __future__ import annotations

import os
import shutil
from string import Template

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweave.functions import text

#: The formats of the generated pages and files.
INDEX_HEAD = "# Documentation Index\n\n| Module | Type | Used By |\n| --- | --- | --- |\n"
SITE = Template("""import { defineConfig } from 'vitepress'

export default defineConfig({
  title: '$title',
  ignoreDeadLinks: true,
  themeConfig: {
${edit}    sidebar: [
      {
        text: 'Modules',
        items: [
$modules        ],
      },
      {
        text: 'Shared',
        items: [
$shared        ],
      },
    ],
  },
})
""")
EDIT = Template("    editLink: {\n      pattern: '$url/edit/main/:path',\n    },\n")
ITEM = Template("          { text: '$id', link: '/$folder/$id.md' },\n")
PACKAGE = """{
  "private": true,
  "scripts": {
    "docs:build": "vitepress build",
    "docs:preview": "vitepress preview",
    "docs:dev": "vitepress dev"
  },
  "devDependencies": {
    "vitepress": "^1.6.4"
  }
}
"""


def _section(title: str, rows: Column) -> Column:
    body = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("- "), r, F.lit("\n"))), "")
    return F.when(F.size(rows) > 0, F.concat(F.lit(f"\n## {title}\n\n"), body)).otherwise(F.lit(""))


def _code(s: Column) -> Column:
    return F.concat(F.lit("`"), s, F.lit("`"))


def shared_page(module: Column, summary: Column, types: Column, functions: Column, refs: Column) -> Column:
    """The page of a shared module; sections without entries are left out."""

    def entry(f: Column) -> Column:
        signature = F.when(f["signature"] != "", F.concat(F.lit(": "), _code(f["signature"]))).otherwise(F.lit(""))
        source = F.when(f["ref"] != "", F.concat(F.lit(" ([source]("), f["ref"], F.lit("))"))).otherwise(F.lit(""))
        return F.concat(_code(f["name"]), signature, source)

    page = F.concat(
        F.lit("# "), module, F.lit("\n\n"), summary, F.lit("\n"),
        _section("Key Types", F.transform(types, _code)),
        _section("Key Functions", F.transform(functions, entry)),
        _section("Source References", F.transform(refs, _code)),
    )
    return F.concat(text.trim_space(page), F.lit("\n"))


def index_row(id: Column, shared: Column, referenced_by: Column) -> Column:
    used = F.when(shared & (F.size(referenced_by) > 0), F.array_join(referenced_by, ", ")).otherwise(F.lit("-"))
    return F.concat(F.lit("| "), id, F.lit(" | "), F.when(shared, F.lit("shared")).otherwise(F.lit("module")), F.lit(" | "), used, F.lit(" |"))


def index_page(modules: DataFrame, depth: DataFrame | None = None) -> str:
    """The index page, by (depth, id); without ``depth`` (node, depth) all depths are 0."""
    rows = modules.select("id", index_row(F.col("id"), F.col("shared"), F.col("referenced_by")).alias("line"))
    if depth is None:
        rows = rows.withColumn("depth", F.lit(0))
    else:
        rows = rows.join(depth.select(F.col("node").alias("id"), "depth"), "id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    return INDEX_HEAD + "".join(r["line"] + "\n" for r in rows.orderBy("depth", "id").toLocalIterator())


def site_config(modules: DataFrame, title: str, repo_path: str, repo_url: str) -> str:
    """The site's configuration: sidebar groups by id, an edit link only with a repository address."""
    groups = {False: "", True: ""}
    for r in modules.select("id", "shared").orderBy("id").toLocalIterator():
        groups[r["shared"]] += ITEM.substitute(id=r["id"], folder="shared" if r["shared"] else "modules")
    return SITE.substitute(
        title=title or os.path.basename(os.path.normpath(repo_path)) or ".",
        edit=EDIT.substitute(url=repo_url) if repo_url else "", modules=groups[False], shared=groups[True],
    )


def write_assets(folder: str, config: str, logo: str = "") -> None:
    for path, body in ((".vitepress/config.mts", config), ("package.json", PACKAGE)):
        full = os.path.join(folder, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8") as f:
            f.write(body)
    if logo:
        os.makedirs(os.path.join(folder, "public"), exist_ok=True)
        shutil.copyfile(logo, os.path.join(folder, "public", "logo.png"))
