"""Readers and writers of a vault: Markdown notes and node files with front matter, JSON configuration, attachments."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import schema as S
from ..functions.text import body, frontmatter
from ..operators.tables import described

#: Markers of the generated part of a node file and of the user's section behind it.
AUTO_MARKER, USER_MARKER = "<!-- generated: do not edit -->", "<!-- user -->"


def _to_json(blocks: pa.Array) -> pa.Array:

    import yaml

    out = []
    for b in blocks.to_pylist():
        try:
            found = yaml.safe_load(b or "")
        except yaml.YAMLError:
            found = None
        out.append(json.dumps(found if isinstance(found, dict) else {}, ensure_ascii=False, default=str))
    return pa.array(out, pa.string())


def yaml_json(block: Column) -> Column:
    """Front matter as JSON text; anything that isn't a mapping is an empty one. YAML has no built-in reader, so this is an Arrow batch function."""
    return F.arrow_udf(_to_json, StringType())(block)


def files(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """``path``, ``text`` of whole files, found recursively."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.decode("content", "UTF-8").alias("text"))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Node files as rows of ``schema.NODES`` and ``sources``; files without a slug and redirects are left in for the caller to filter."""
    kind = "slug string, type string, display_label string, aliases array<string>, description string, note string, categories array<string>, anchor_id string, created_at string, merged_from array<string>, redirect_to string, sources array<struct<slug: string, title: string, concept_slug: string>>"
    rows = files(spark, path).select("path", "text", F.from_json(yaml_json(frontmatter(F.col("text"))), kind).alias("f"))
    return rows.select(F.col("f.type").alias("node_type"), "f.*", body(F.col("text")).alias("body")).drop("type")


def mentions_of(nodes: DataFrame) -> DataFrame:
    """Rows of ``schema.MENTIONS``."""
    return nodes.select("node_type", F.col("slug").alias("node_slug"), F.posexplode("sources").alias("ord", "s")).select("node_type", "node_slug", "ord", F.col("s.slug").alias("paper_slug"), F.col("s.title").alias("paper_title"), F.col("s.concept_slug").alias("concept_slug"))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes ``<slug>/<slug>.md`` with title (the slug without one), authors, tags (a single one too) and body."""
    rows = files(spark, path).withColumn("slug", F.regexp_extract("path", r"/([^/]+)/\1\.md$", 1)).filter("slug <> ''")
    rows = rows.withColumn("slug", F.url_decode(F.replace("slug", F.lit("+"), F.lit("%2B"))))
    j = yaml_json(frontmatter(F.col("text")))
    rows = rows.withColumn("j", j).select("slug", "text", F.get_json_object("j", "$.title").alias("title"), F.get_json_object("j", "$.authors").alias("authors"), F.get_json_object("j", "$.tags").alias("t"))
    tags = F.when(F.col("t").startswith("["), F.from_json("t", "array<string>")).when(F.col("t").isNotNull(), F.array("t")).otherwise(F.array().cast("array<string>"))
    return rows.select("slug", F.coalesce(F.nullif("title", F.lit("")), "slug").alias("title"), "authors", tags.alias("tags"), body(F.col("text")).alias("body"))


def read_config(spark: SparkSession, path: str, kind) -> DataFrame:
    """A JSON array as rows of a schema; an empty table if the file isn't there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(conf).exists(p):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).json(path, multiLine=True)


def read_folders(spark: SparkSession, path: str) -> DataFrame:
    return read_config(spark, path, S.FOLDERS)


def read_brains(spark: SparkSession, path: str) -> DataFrame:
    return read_config(spark, path, S.BRAINS)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return read_config(spark, path, S.CANDIDATES)


def relation_types(spark: SparkSession) -> DataFrame:
    """The default vocabulary."""
    return spark.createDataFrame(list(S.RELATION_TYPE_SYMMETRY.items()), "rel_type string, symmetric boolean")


def read_relation_types(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary from a JSON file, ``{"types": {name: {"symmetric": ...}}}``; the default one where the file is missing, broken or empty."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(conf).exists(p):
        return relation_types(spark)
    text = spark.read.text(path, wholetext=True)
    found = text.select(F.from_json("value", "types map<string, struct<symmetric: boolean>>")["types"].alias("t"))
    rows = found.select(F.explode("t").alias("rel_type", "x")).select("rel_type", F.coalesce("x.symmetric", F.lit(False)).alias("symmetric"))
    return rows if rows.limit(1).count() else relation_types(spark)


def type_texts(types: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(rel_type, text): what a relation type is embedded by, its name and description."""
    d = described(types, descriptions)
    return d.select("rel_type", F.concat("rel_type", F.lit(": "), "description").alias("text"))


def members(containers: DataFrame, key: str) -> DataFrame:
    """``paper_slugs`` of folders or brains, one row each in order."""
    return containers.select(F.col("id").alias(key), F.posexplode("paper_slugs").alias("pos", "paper_slug"))


def find_attachment(listing: DataFrame, folder: str, name: str) -> DataFrame:
    """``listing``: path. The file of this name beside its owner, else the first elsewhere by path; only images."""
    base = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*S.IMAGE_EXTENSIONS)
    hits = listing.filter(kind & (base == name.rsplit("/", 1)[-1]))
    return hits.orderBy(~F.col("path").contains(f"/{folder}/"), "path").limit(1)


def duplicates_by_hash(papers: DataFrame, arrivals: DataFrame) -> DataFrame:
    """``arrivals``: id, text. (id, slug): the first paper with the same text."""
    h = arrivals.select("id", F.sha2("text", 256).alias("text_hash"))
    first = papers.groupBy("text_hash").agg(F.min("slug").alias("slug"))  # a row for each text, so that copies don't pair up
    return h.join(first, "text_hash").select("id", "slug")


def render_node(label: Column, node_type: Column, aliases: Column, categories: Column, sources: Column, description: Column, note: Column) -> Column:
    """The generated part of a node file: heading, other names, categories of concepts, papers, then the description after a rule."""
    names = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("none"))
    papers = F.filter(sources, lambda s: F.coalesce(s["slug"], F.lit("")) != "")
    lines = F.transform(sources, lambda s: F.when(F.coalesce(s["slug"], F.lit("")) != "", F.concat(F.lit("- [["), s["slug"], F.lit("|"), F.coalesce(s["title"], s["slug"]), F.lit("]]"))).otherwise("- (no paper: linked to a concept)"))
    some = lambda c: F.nullif(c, F.lit(""))
    about = F.concat_ws("\n", some(description), F.when(some(note).isNotNull(), F.concat(F.lit("*"), note, F.lit("*"))))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("# "), label), F.lit(""), F.concat(F.lit("**Other names**: "), names(aliases)),
        F.when(node_type == "concept", F.concat(F.lit("\n**Categories**: "), names(categories))),
        F.concat(F.lit("\n**Papers**: "), F.size(papers).cast("string")),
        some(F.array_join(lines, "\n")),
        F.when(about != "", F.concat(F.lit("\n---\n\n"), about)),
    )


def front_matter(**fields: Column) -> Column:
    """Lines between rules; each value is written as JSON, which is YAML too. Null fields are left out."""
    lines = (F.concat(F.lit(f"{k}: "), json_of(c)) for k, c in fields.items())
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def json_of(value: Column) -> Column:
    """JSON text of any value; null stays null."""
    whole = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))  # without {"v": and }


def node_file(node_type: Column, slug: Column, label: Column, aliases: Column, categories: Column, sources: Column, description: Column, note: Column, created_at: Column, merged_from: Column, redirect_to: Column, user: Column) -> Column:
    """A whole node file: front matter, the generated part, and the user's section behind its marker. ``read_nodes`` reads it back."""
    head = front_matter(slug=slug, type=node_type, display_label=label, aliases=aliases, categories=F.when(node_type == "concept", categories), description=description, note=note, created_at=created_at,
                        merged_from=merged_from, redirect_to=redirect_to, sources=sources)
    return F.concat(head, F.lit(f"\n{AUTO_MARKER}\n\n"), render_node(label, node_type, aliases, categories, sources, description, note), F.lit(f"\n\n---\n\n{USER_MARKER}\n"), F.coalesce(user, F.lit("")))


def summary_file(payload: Column) -> Column:
    """What a run has to say about a paper, as indented JSON."""
    return F.to_json(payload, {"pretty": "true"})


def write_files(files: DataFrame, root: str) -> DataFrame:
    """``files``: path (below ``root``), content. Each file is written whole by the task that holds its row, to any file system that the workers reach; a task that runs again overwrites its
    files. Returns the paths; nothing happens before they are asked for."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = f"{base.rstrip('/')}/{path}"
                system.create_dir(whole.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(whole) as f:
                    f.write((content or "").encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])

    return files.select("path", "content").mapInArrow(put, "path string")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> int:
    """The mirror: both tables rebuilt from the truth, as one version that readers see whole; its number."""
    from . import versions

    spark, number = nodes.sparkSession, versions.latest(nodes.sparkSession, path) + 1
    folders = {name: f"{name}-{uuid.uuid4().hex}" for name in ("nodes", "edges")}
    nodes.write.parquet(f"{path}/{folders['nodes']}")
    edges.write.parquet(f"{path}/{folders['edges']}")
    versions.put_new(spark, f"{path}/commits/{number:012}.json", json.dumps(folders))
    return number


def read_graph(spark: SparkSession, path: str, number: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a version of the mirror, the newest by default."""
    from . import versions

    folders = json.loads(versions.get(spark, f"{path}/commits/{number or versions.latest(spark, path):012}.json"))
    return spark.read.parquet(f"{path}/{folders['nodes']}"), spark.read.parquet(f"{path}/{folders['edges']}")


def list_papers(spark: SparkSession, path: str) -> DataFrame:
    """Slugs of the folders below a path that hold files and don't start with an underscore, sorted."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    root = path.rstrip("/").rsplit("/", 1)[-1]
    slug = F.regexp_extract("path", rf"/{root}/([^/]+)/", 1)
    return listing.select(slug.alias("slug")).filter("slug <> '' and not startswith(slug, '_')").distinct().orderBy("slug")


def papers_by_age(spark: SparkSession, path: str) -> DataFrame:
    """Slugs of the folders with a note of their name, the oldest note first."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    found = listing.select(F.regexp_extract("path", r"/([^/]+)/\1\.md$", 1).alias("slug"), "modificationTime").filter("slug <> ''")
    return found.orderBy("modificationTime", "slug").select("slug", "modificationTime")


def render_note(title: Column, tldr: Column, motivation: Column, claims: Column, concepts: Column, entities: Column, limitations: Column) -> Column:
    """The body of a paper's note: summary, motivation, numbered claims, references (an entity shows its concept), limitations."""
    from ..functions.text import table_cell

    cell = lambda c: table_cell(F.coalesce(c, F.lit("")))
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    none = F.lit("_none_")
    numbered = F.transform(claims, lambda c, i: row((i + 1).cast("string"), cell(c["claim"]), cell(c["evidence"])))
    claim_table = F.when(F.size(claims) > 0, F.concat(F.lit("| # | Claim | Evidence |\n|---|---|---|\n"), F.array_join(numbered, "\n"))).otherwise(none)
    label = lambda c: F.concat(F.lit("[["), cell(c["label"]), F.lit("]]"))
    parent = lambda e: F.element_at(F.filter(concepts, lambda c: c["id"] == e["concept_id"])["label"], 1)
    has = lambda e: F.exists(concepts, lambda c: c["id"] == e["concept_id"])
    rows = F.concat(
        F.transform(concepts, lambda c: row(label(c), cell(c["description"]), cell(c["note"]))),
        F.transform(entities, lambda e: row(label(e), cell(e["description"]), F.when(has(e), cell(parent(e))).otherwise(cell(e["note"])))),
    )
    references = F.when(F.size(rows) > 0, F.concat(F.lit("| Concept | Description | Note |\n|---|---|---|\n"), F.array_join(rows, "\n"))).otherwise(none)
    bullets = F.array_join(F.transform(motivation, lambda m: F.concat(F.lit("- "), m)), "\n")
    part = lambda head, c: F.concat(F.lit(f"## {head}\n"), c)
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), F.concat(F.lit("> **TL;DR**: "), tldr), part("Problem and motivation", bullets), part("Claims", claim_table), part("Concepts and methods", references), part("Limitations", limitations))


def without_repeated_header(text: Column, label: str = "Authors") -> Column:
    """Older notes repeat authors and tags below the heading; the heading stays, and a line in italics if there is one. Line ends of either kind."""
    nl = r"\r?\n"
    pattern = rf"(?m)(^#[^\r\n]*{nl}{nl})\*\*{label}\*\*:[^\r\n]*{nl}(?:(\*[^\r\n]*\*)({nl}))?(?:#\S[^\r\n]*{nl})?({nl})"
    return F.regexp_replace(text, pattern, "$1$2$3$3")
