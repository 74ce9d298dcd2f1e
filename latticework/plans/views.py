"""Domain tables over the star-schema inputs: the same text serves Spark and DuckDB."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "brains": "select concat('b', r_regionkey) as id, r_name as name from {region}",
    "folders": """select concat('f', n_nationkey) as id, n_name as name,
        case when n_nationkey % 5 = 4 then null else concat('b', n_regionkey) end as brain_id from {nation}""",
    "papers": "select concat('o', o_orderkey) as slug, concat('Order ', o_orderkey) as title, o_orderpriority as tag, o_custkey as custkey from {orders}",
    "folder_papers": """select concat('f', c_nationkey) as folder_id, concat('o', o_orderkey) as paper_slug
        from {orders} join {customer} on o_custkey = c_custkey where o_orderkey % 3 <> 0""",
    "brain_papers": "select concat('b', o_custkey % 5) as brain_id, concat('o', o_orderkey) as paper_slug from {orders} where o_orderkey % 2 = 0",
    "concepts": "select concat('p', p_partkey) as slug, concat(p_name, ' ', p_partkey) as display_label, p_type as category from {part}",
    "entities": """select concat('s', s_suppkey) as slug, s_name as display_label from {supplier}
        union all select concat('n', n_nationkey) as slug, n_name as display_label from {nation}""",
    "concept_mentions": "select concat('p', l_partkey) as node_slug, concat('o', l_orderkey) as paper_slug from {lineitem} where l_linenumber = 1",
    "entity_mentions": """select concat('s', l_suppkey) as node_slug,
        case when l_returnflag = 'A' and l_quantity >= 45 then null else concat('o', l_orderkey) end as paper_slug,
        case when l_returnflag = 'A' then concat('p', l_partkey) when l_returnflag = 'N' then concat('dead', l_partkey) end as concept_slug
        from {lineitem} where l_linenumber = 2""",
    "relations_raw": """select case when l_linenumber = 3 then 'entity' else 'concept' end as from_type,
        case when l_linenumber = 3 then concat('s', l_suppkey) else concat('p', l_partkey) end as from_slug,
        case l_orderkey % 12 when 0 then 'PART_OF' when 1 then 'IS_A' when 2 then 'USES' when 3 then 'EXTENDS' when 4 then 'IMPROVES_ON'
          when 5 then 'OUTPERFORMS' when 6 then 'SOLVES' when 7 then 'EVALUATED_ON' when 8 then 'LIMITED_BY' when 9 then 'COMPARED_TO'
          when 10 then 'CONTRADICTS' else 'RELATED' end as rel_type,
        case when l_linenumber = 3 then 'concept' else 'entity' end as to_type,
        case when l_linenumber = 3 then concat('p', l_partkey) else concat('s', l_suppkey) end as to_slug,
        case when l_quantity < 10 then '' else concat('because ', l_returnflag, ' ', cast(l_suppkey as {string})) end as rationale,
        concat('o', l_orderkey) as paper_slug
        from {lineitem} where l_linenumber in (3, 4)""",
    "notes": """select concat('o', o_orderkey) as slug, concat('see [[o', o_custkey, ']], [[ o', o_orderkey, ' |me]], [[o', o_custkey, '#part]] ![[fig', o_orderkey % 3, '.PNG]] ![[fig', o_orderkey % 3, '.PNG]]',
        ' ![x](img/fig', o_custkey % 3, '.png) [[plan.excalidraw]] [[nowhere]] [[a]b]]') as body from {orders}""",
    "node_bodies": """select concat('concept:', p_name, ' ', p_partkey) as id, concat('p', p_partkey) as slug, 'concept' as type,
        concat('mine ![a](attachments/concepts/p', p_partkey, '/', p_size % 2, '.png) and ![b](x/', p_size % 2, '.png) [[o1]]') as body from {part}""",
    "relation_types": """select * from (values ('PART_OF', false), ('IS_A', false), ('USES', false), ('EXTENDS', false), ('IMPROVES_ON', false),
        ('OUTPERFORMS', false), ('SOLVES', false), ('EVALUATED_ON', false), ('LIMITED_BY', false), ('COMPARED_TO', true),
        ('CONTRADICTS', true), ('RELATED', true)) as t(rel_type, {symmetric})""",
}


def duckdb_with(*names: str) -> str:
    """``with`` clause of the views named, for DuckDB."""
    given = {t: t for t in TABLES} | {"string": "varchar", "symmetric": '"symmetric"'}  # a reserved word there
    return "with " + ",\n".join(f"{n} as ({VIEWS[n].format(**given)})" for n in names)


class Views:
    """The domain tables of a folder of inputs, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    def view(self, name: str) -> DataFrame:
        if name not in self._made:
            text = VIEWS[name].replace("{string}", "string").replace("{symmetric}", "symmetric")
            used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
            self._made[name] = self.spark.sql(text, **used)
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def nodes(self) -> DataFrame:
        """``node_type``, ``slug``, ``display_label`` of all live nodes."""
        from ..operators.tables import typed

        return typed(self.concepts, "concept").unionByName(typed(self.entities, "entity"))

    @cached_property
    def mentions(self) -> DataFrame:
        """``node_type``, ``node_slug``, ``paper_slug``, ``concept_slug``."""
        from pyspark.sql import functions as F

        c = self.concept_mentions.select(F.lit("concept").alias("node_type"), "node_slug", "paper_slug", F.lit(None).cast("string").alias("concept_slug"))
        return c.unionByName(self.entity_mentions.select(F.lit("entity").alias("node_type"), "node_slug", "paper_slug", "concept_slug"))
