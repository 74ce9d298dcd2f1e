"""Every operator as a query over the adapter views, with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import minhash as M
from .functions import text as T
from .operators import components as C
from .operators import graph as G
from .operators import resolve as R
from .operators import scope as SC
from .operators import search as SE
from .operators import store as ST
from .operators import tables as TB
from .plans.views import Views, duckdb_with
from .sources import vault
from .storage import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- common table expressions of the SQL side ----
BASE = duckdb_with("brains", "folders", "papers", "folder_papers", "brain_papers", "concepts", "entities", "concept_mentions", "entity_mentions", "relations_raw", "relation_types")
NODES = f"""{BASE},
nodes as (select 'concept' as node_type, slug, display_label from concepts union all select 'entity', slug, display_label from entities),
mentions as (select 'concept' as node_type, node_slug, paper_slug, null::varchar as concept_slug from concept_mentions
  union all select 'entity', node_slug, paper_slug, concept_slug from entity_mentions)"""
GRAPH_NODES = f"""{NODES},
gn as (select slug as id, title as label, 'note' as type, false as orphan from papers
  union all select distinct 'tag:' || tag, tag, 'tag', false from papers where tag is not null
  union all select node_type || ':' || display_label, display_label, node_type,
    not exists (select 1 from mentions m where m.node_type = n.node_type and m.node_slug = n.slug) from nodes n)"""
EDGES = f"""{GRAPH_NODES},
es as (select m.*, coalesce('concept:' || c.display_label, p.slug) as source, c.slug is not null as on_concept from entity_mentions m
  left join concepts c on c.slug = m.concept_slug left join papers p on p.slug = m.paper_slug
  where c.slug is not null or p.slug is not null),
pe as (select m.paper_slug as source, 'concept:' || c.display_label as target, 'link' as type from concept_mentions m
    join concepts c on c.slug = m.node_slug join papers p on p.slug = m.paper_slug
  union all select es.source, 'entity:' || e.display_label, 'link' from es join entities e on e.slug = es.node_slug),
te as (select slug as source, 'tag:' || tag as target, 'tag' as type from papers where tag is not null),
se as (select f.node_type || ':' || f.display_label as source, t.node_type || ':' || t.display_label as target, 'semantic' as type,
    r.rel_type as relation, coalesce(y."symmetric", false) as "symmetric"
  from relations_raw r join nodes f on f.node_type = r.from_type and f.slug = r.from_slug
  join nodes t on t.node_type = r.to_type and t.slug = r.to_slug left join relation_types y on y.rel_type = r.rel_type),
mirror as (select distinct 'paper' as src_type, m.paper_slug as src_slug, 'concept' as dst_type, m.node_slug as dst_slug
    from concept_mentions m join concepts c on c.slug = m.node_slug join papers p on p.slug = m.paper_slug
  union select case when on_concept then 'concept' else 'paper' end, case when on_concept then concept_slug else paper_slug end, 'entity', es.node_slug
    from es join entities e on e.slug = es.node_slug)"""
NOTES = duckdb_with("notes", "node_bodies").removeprefix("with ")
FOCUS = "focus as (select distinct paper_slug as id from concept_mentions order by 1 limit 5)"


def pruned(edges: str) -> str:
    return f"""{EDGES}, {FOCUS}, e as materialized ({edges}), g as materialized (select * from gn),
k1 as materialized (select id from focus union select e.target from e join focus on focus.id = e.source
  union select e.source from e join focus on focus.id = e.target anti join focus f on f.id = e.source
  union select id from g where orphan),
k2 as materialized (select id from k1 union select e.target from e join (select distinct id from k1 join g using (id) where g.type = 'concept') c on c.id = e.source
  join (select distinct id from g where type = 'entity') t on t.id = e.target)"""


def kept(columns: str = "e.*") -> str:
    return f"select {columns} from e semi join k2 s on s.id = e.source semi join k2 t on t.id = e.target"


PROVENANCE = "select source, target, type from pe union all select source, target, type from te"
ALL_EDGES = PROVENANCE + " union all select source, target, type from se"


def provenance(v: Views) -> DataFrame:
    return G.provenance_edges(v.papers, v.concepts, v.entities, v.concept_mentions, v.entity_mentions)


def semantic(v: Views) -> DataFrame:
    return G.semantic_edges(v.relations_raw, v.nodes, v.relation_types)


def plain_edges(v: Views, with_semantic: bool = False) -> DataFrame:
    """Edges with the types of their ends, so that type filters reach the tables they come from."""
    kinds = ["source", "target", "type", "source_type", "target_type"]
    e = G.provenance_edges(v.papers, v.concepts, v.entities, v.concept_mentions, v.entity_mentions, typed=True)
    e = e.unionByName(G.tag_edges(v.papers).withColumns({"source_type": F.lit("note"), "target_type": F.lit("tag")}))
    return e.unionByName(G.semantic_edges(v.relations_raw, v.nodes, v.relation_types, typed=True).select(*kinds)) if with_semantic else e


def all_nodes(v: Views) -> DataFrame:
    return G.graph_nodes(v.papers, v.nodes, v.mentions)


def focus(v: Views) -> DataFrame:
    return v.concept_mentions.select(F.col("paper_slug").alias("id")).distinct().orderBy("id").limit(5)


# ---- graph views ----
@query(f"{GRAPH_NODES} select * from gn")
def graph_nodes(v):
    return all_nodes(v)


@query(f"{EDGES} select * from pe")
def graph_edges_provenance(v):
    return provenance(v)


@query(f"{EDGES} select * from se")
def graph_edges_semantic(v):
    return semantic(v)


@query(f"{EDGES} select * from mirror")
def graph_edges_mirror_set(v):
    return G.mirror_edges(v.papers, v.concepts, v.entities, v.concept_mentions, v.entity_mentions)


@query(f"{EDGES} select * from te")
def tag_edges(v):
    return G.tag_edges(v.papers)


@query(f"{pruned(PROVENANCE)} select g.* from g semi join k2 on k2.id = g.id")
def focus_subgraph_nodes(v):
    return G.focus_subgraph(all_nodes(v), plain_edges(v), focus(v))[0]


@query(f"{pruned(PROVENANCE)} {kept()}")
def focus_subgraph_edges(v):
    return G.focus_subgraph(all_nodes(v), plain_edges(v), focus(v))[1].select("source", "target", "type")


@query(f"{pruned(ALL_EDGES)} {kept()}")
def focus_semantic(v):
    return G.focus_subgraph(all_nodes(v), plain_edges(v, True), focus(v))[1].select("source", "target", "type")


@query(f"{GRAPH_NODES} select id, label, type from gn where orphan")
def orphan_nodes(v):
    return all_nodes(v).filter("orphan").select("id", "label", "type")


@query(f"{EDGES} select * from ({ALL_EDGES}) where source in (select id from gn where type not in ('tag', 'entity')) and target in (select id from gn where type not in ('tag', 'entity'))")
def visible_edges(v):
    return G.visible(all_nodes(v), plain_edges(v, True), ("tag", "entity"))[1].select("source", "target", "type")


@query(f"{GRAPH_NODES} select id, label, type from gn where contains(lower(label), 'anvil') and type not in ('tag') order by label, id limit 12")
def node_label_search(v):
    return TB.label_search(all_nodes(v), " Anvil ", ("tag",)).select("id", "label", "type")


@query(f"{EDGES} select distinct id from (select unnest([source, target]) as id from ({ALL_EDGES}) where source = 'tag:1-URGENT' or target = 'tag:1-URGENT' union all select 'tag:1-URGENT')")
def hover_neighbourhood(v):
    return G.neighbourhood(plain_edges(v, True), "tag:1-URGENT")


@query("select concat('p', vec_id) as id, round(sqrt((x - 0.1) ** 2 + (y + 0.2) ** 2), 9) as distance from (select vec_id, embedding[1]::double as x, embedding[2]::double as y from embeddings) order by sqrt((x - 0.1) ** 2 + (y + 0.2) ** 2), id limit 1")
def nearest_node(v):
    points = v.embeddings.select(F.concat(F.lit("p"), "vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return TB.nearest(points, 0.1, -0.2).select("id", F.round("distance", 9).alias("distance"))


@query(f"{GRAPH_NODES} select count(*) filter (type = 'note')::bigint as papers, count(*) filter (type in ('concept', 'entity'))::bigint as nodes from gn")
def graph_stats(v):
    return G.stats(all_nodes(v))


@query(f"{pruned(PROVENANCE)} select type, count(*)::bigint as n, string_agg(label, '|' order by label) as labels from g semi join k2 on k2.id = g.id where type in ('concept', 'entity') group by type")
def node_summary(v):
    n = G.focus_subgraph(all_nodes(v), plain_edges(v), focus(v))[0].filter(F.col("type").isin("concept", "entity"))
    return n.groupBy("type").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("label")), "|").alias("labels"))


@query(f"{NODES} select n.node_type, count(*)::bigint as nodes, count(distinct m.paper_slug)::bigint as papers from nodes n left join mentions m on m.node_type = n.node_type and m.node_slug = n.slug group by n.node_type")
def mirror_counts(v):
    j = v.nodes.select("node_type", F.col("slug").alias("node_slug")).join(v.mentions, ["node_type", "node_slug"], "left")
    counted = j.groupBy("node_type").agg(F.count_distinct("paper_slug").alias("papers"))
    return v.nodes.groupBy("node_type").agg(F.count("*").alias("nodes")).join(counted, "node_type")


ORACLE_SQL["mirror_counts"] = f"{NODES} select node_type, (select count(*) from nodes x where x.node_type = n.node_type)::bigint as nodes, (select count(distinct paper_slug) from mentions m join nodes x on x.node_type = m.node_type and x.slug = m.node_slug where m.node_type = n.node_type)::bigint as papers from (select distinct node_type from nodes) n"

# ---- scope ----
PB = f"""{NODES},
pf as (select paper_slug, min(folder_id) as folder_id from folder_papers join folders f on f.id = folder_id group by paper_slug),
pd as (select paper_slug, min(brain_id) as direct from brain_papers group by paper_slug),
pb as (select p.slug as paper_slug, case when pf.folder_id is not null then f.brain_id else pd.direct end as brain_id
  from papers p left join pf on pf.paper_slug = p.slug left join folders f on f.id = pf.folder_id left join pd on pd.paper_slug = p.slug),
nb as (select m.node_type, m.node_slug, list_sort(list_distinct(list(pb.brain_id) filter (pb.brain_id is not null))) as ids
  from mentions m left join pb on pb.paper_slug = m.paper_slug group by all)"""


def brains_of(v: Views) -> DataFrame:
    return SC.paper_brain(v.papers, v.folders, v.folder_papers, v.brain_papers)


@query(f"{PB} select * from pb")
def paper_brain(v):
    return brains_of(v)


@query(f"{PB} select node_type, node_slug, coalesce(array_to_string(ids, ','), '') as brain_ids from nb")
def node_brain_ids(v):
    return SC.node_brain_ids(v.mentions, brains_of(v)).withColumn("brain_ids", F.array_join("brain_ids", ","))


@query(f"""{PB} select coalesce(brain_id, 'none') as bucket, 'folder' as kind, id as item from folders
  union all select coalesce(pd.direct, 'none'), 'paper', p.slug from papers p left join pd on pd.paper_slug = p.slug where p.slug not in (select paper_slug from folder_papers)""")
def brain_contents(v):
    return SC.brain_contents(v.papers, v.folders, v.folder_papers, v.brain_papers)


@query(f"""{BASE} select 'folder' as kind, id as item, case when brain_id = 'b1' then 'b0' else brain_id end as brain_id from folders
  union all select distinct 'paper', paper_slug, case when brain_id = 'b1' then 'b0' else brain_id end from brain_papers""")
def merge_brains(v):
    f, b = SC.merge_brains(v.folders, v.brain_papers, "b0", "b1")
    return f.select(F.lit("folder").alias("kind"), F.col("id").alias("item"), "brain_id").unionByName(b.select(F.lit("paper").alias("kind"), F.col("paper_slug").alias("item"), "brain_id"))


@query(f"{BASE} select 'folder' as kind, id as item from folders where brain_id = 'b2' union all select 'paper', paper_slug from brain_papers where brain_id = 'b2'")
def delete_brain_effects(v):
    return SC.delete_brain_effects(v.folders, v.brain_papers, "b2")


@query(f"{BASE} select id, name, nullif(brain_id, 'b2') as brain_id from folders")
def delete_brain_folders(v):
    return SC.delete_brain(v.brains, v.folders, v.brain_papers, "b2")[1].select("id", "name", "brain_id")


@query(f"{BASE} select id, name from folders where lower(trim(name)) = lower(trim(' nation_7 '))")
def folder_name_taken(v):
    return SC.name_taken(v.folders, F.lit(" nation_7 ")).select("id", "name")


@query(f"{BASE} select folder_id, paper_slug from folder_papers where paper_slug <> 'o1' union all select 'f3', 'o1'")
def set_paper_folder(v):
    return SC.move_paper(v.folder_papers, "o1", "f3")


@query(f"{BASE} select distinct paper_slug from folder_papers where folder_id in ('f1', 'f2')")
def resync_papers(v):
    return SC.affected_papers(v.folder_papers, ["f1", "f2"])


@query(f"{BASE} select folder_id from folder_papers left join (select slug from papers where tag in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')) s on s.slug = paper_slug group by folder_id having bool_and(s.slug is not null)")
def active_folders(v):
    chosen = v.papers.filter(F.col("tag").isin("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")).select(F.col("slug").alias("paper_slug"))
    return SC.active_folders(v.folder_papers, chosen)


@query(f"{BASE} select id, name, row_number() over (order by coalesce(case when id in ('b1', 'b4') then null else concat('2024-0', 9 - substr(id, 2)::int) end, ''), id) as place from brains")
def list_brains(v):
    """By time of creation, those without one first."""
    times = F.when(~F.col("id").isin("b1", "b4"), F.concat(F.lit("2024-0"), 9 - F.substring("id", 2, 9).cast("int")))
    listed = SC.ordered(v.brains.withColumn("created_at", times)).agg(F.collect_list(F.struct("id", "name")).alias("x"))  # a handful of containers, in their order
    return listed.select(F.posexplode("x").alias("at", "x")).select("x.*", (F.col("at") + 1).cast("long").alias("place"))


# ---- point lookups and joins ----
@query(f"{NODES} select distinct m.paper_slug, n.slug, n.display_label from mentions m join nodes n on n.node_type = m.node_type and n.slug = m.node_slug where m.node_type = 'concept'")
def paper_concepts(v):
    return TB.concepts_of_papers(v.mentions, v.concepts)


@query(f"{NODES} select distinct concept_slug, node_slug from mentions where node_type = 'entity' and concept_slug in (select slug from concepts)")
def entities_by_concept(v):
    return TB.entities_of_concepts(v.mentions, v.concepts)


@query(f"{NODES} select distinct node_type, node_slug from mentions where paper_slug = 'o7'")
def nodes_by_paper(v):
    return TB.nodes_of_paper(v.mentions, F.lit("o7"))


@query(f"{BASE} select slug, coalesce(nullif(title, ''), slug) as title from papers union all select 'missing', 'missing'")
def paper_titles(v):
    listed = v.papers.select("slug").union(v.spark.sql("select 'missing' as slug"))
    return TB.paper_titles(v.papers, listed)


@query(f"{BASE} select rel_type, case rel_type when 'USES' then 'A uses B' else rel_type end as description from relation_types")
def describe_relation_types(v):
    return TB.described(v.relation_types, v.spark.sql("select 'USES' as rel_type, 'A uses B' as description"))


@query(f"{BASE} select rel_type, count(*)::bigint as n from relations_raw where rel_type in (select rel_type from relation_types where rel_type <> 'RELATED') group by rel_type")
def known_relation_counts(v):
    return TB.known_relations(v.relations_raw, v.relation_types.filter("rel_type <> 'RELATED'")).groupBy("rel_type").agg(F.count("*").alias("n"))


@query("""select sum(round((c_custkey * 2.0 + c_nationkey * 10.0 + c_custkey * 2.0 * 1.25) / 1000000, 9)) as cost_usd from customer""")
def ingest_cost(v):
    usage = v.customer.select(F.lit("m").alias("model"), F.col("c_custkey").alias("input_tokens"), F.col("c_nationkey").alias("output_tokens"), F.col("c_custkey").alias("cache_write_tokens"), F.lit(None).cast("long").alias("cache_read_tokens"))
    prices = v.spark.sql("select 'm' as model, 2.0d as input_price, 10.0d as output_price")
    return TB.cost(usage, prices).agg(F.round(F.sum(F.round("cost", 9)), 4).alias("cost_usd"))


ORACLE_SQL["ingest_cost"] = "select round(sum(round((c_custkey * 2.0::double + c_nationkey * 10.0::double + c_custkey * 2.5::double) / 1000000, 9)), 4) as cost_usd from customer"

# ---- labels ----
NORM = "lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9_]+', ' ', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), ' +', ' ', 'g')))"
PART_KEYS = f"pk as (select distinct {NORM.format('p_name')} as key from part)"
SHINGLES = "case when length(key) = 0 then []::varchar[] else list_distinct(list_transform(range(1, greatest(length(key) - 2, 1) + 1), lambda i: substr(key, i, 3))) end"
CRC = """crc as (select list(c order by i) as t from (select i, list_reduce(list_prepend(i::bigint, range(8)::bigint[]),
  lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as c from range(256) r(i)))"""
PERMS = ", ".join(f"({i}, {a}::hugeint, {b}::hugeint)" for i, (a, b) in enumerate(M.permutations()))
SIGNATURES = f"""{CRC}, perms as (select * from (values {PERMS}) as t(i, a, b)),
sh as (select key, unnest({SHINGLES}) as s from pk),
hs as (select key, s, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(encode(s))), lambda i: ('0x' || substr(hex(encode(s)), (2 * i + 1)::int, 2))::bigint)),
  lambda c, b: xor(c // 256, t[(xor(c % 256, b) + 1)::int])), 4294967295)::hugeint as h from sh, crc),
sg as (select key, i, min((a * h + b) % 2305843009213693951) as m from hs, perms group by key, i)"""
MATCHES = """num as (select key, regexp_extract_all(key, '[0-9]+') as n from pk),
eq as (select x.key as a, y.key as b, count(*) as k from sg x join sg y on x.i = y.i and x.m = y.m and x.key < y.key group by all having count(*) >= 47),
suf as (select x.key as a, y.key as b from pk x join pk y on x.key <> '' and starts_with(y.key, x.key) and length(y.key) = length(x.key) + 1),
mp as (select a, b from (select a, b from eq union select a, b from suf) p join num x on x.key = p.a join num y on y.key = p.b where x.n = y.n)"""


@query(f"select distinct p_name as label, {NORM.format('p_name')} as key from part union select s_name, {NORM.format('s_name')} from supplier")
def normalize_labels(v):
    labels = v.part.select(F.col("p_name").alias("label")).union(v.supplier.select(F.col("s_name").alias("label"))).distinct()
    return labels.withColumn("key", T.normalize_label(F.col("label")))


@query(f"with {PART_KEYS} select key, array_to_string(list_sort({SHINGLES}), '|') as shingles, len({SHINGLES})::bigint as n from pk")
def label_shingles(v):
    k = v.part.select(T.normalize_ascii(F.col("p_name")).alias("key")).distinct()
    s = M.shingles(F.col("key"))
    return k.select("key", F.array_join(F.array_sort(s), "|").alias("shingles"), F.size(s).cast("long").alias("n"))


def part_labels(v: Views) -> DataFrame:
    return v.part.select(F.col("p_name").alias("label")).distinct()


@query(f"with {PART_KEYS}, {SIGNATURES} select key, string_agg(m::varchar, ',' order by i) as signature from sg group by key")
def label_minhash(v):
    return R.signed(part_labels(v)).select("key", F.array_join(F.transform("sig", lambda x: x.cast("string")), ",").alias("signature"))


@query(f"with {PART_KEYS}, {SIGNATURES}, {MATCHES} select a, b from mp")
def label_match_pairs(v):
    return R.match_pairs(R.signed(part_labels(v)))


CANON = """labels as (select distinct p_name as label, {norm} as key from part),
e2 as ({edges}),
edges as (select a, b from e2 union select b, a from e2),
cc as (with recursive r(v, c) as (select key, key from pk union select e.b, r.c from r join edges e on e.a = r.v) select v, min(c) as c from r group by v),
best as (select c, min(struct_pack(n := length(label), l := label)) as m from labels join cc on v = key group by c)
select label, m.l as canonical from labels join cc on v = key join best using (c)"""


@query(f"with recursive {PART_KEYS}, {SIGNATURES}, {MATCHES}, {CANON.format(norm=NORM.format('p_name'), edges='select a, b from mp')}")
def label_canonical(v):
    return R.canonical_labels(part_labels(v))


@query(f"""with recursive {PART_KEYS}, {SIGNATURES}, {MATCHES}, al as (select distinct {NORM.format('p_name')} as key, lower(p_brand) as alias from part),
  hub as (select alias, min(key) as a from al group by alias),
  {CANON.format(norm=NORM.format('p_name'), edges='select a, b from mp union select hub.a, al.key from al join hub on hub.alias = al.alias and hub.a < al.key')}""")
def alias_canonical(v):
    aliases = v.part.groupBy(F.col("p_name").alias("label")).agg(F.collect_set("p_brand").alias("aliases"))
    return R.canonical_labels(part_labels(v).join(aliases, "label", "left"))


ORACLE_SQL["alias_canonical"] = ORACLE_SQL["alias_canonical"].replace("lower(p_brand)", NORM.format("p_brand"))


@query(f"select {NORM.format('p_name')} as key, min('p' || p_partkey) as slug from part group by 1")
def name_index(v):
    return R.name_index(v.part.select(F.concat(F.lit("p"), "p_partkey").alias("slug"), F.col("p_name").alias("display_label")))


def named_parts(v: Views) -> DataFrame:
    return v.part.select(F.concat(F.lit("p"), "p_partkey").alias("slug"), F.col("p_name").alias("display_label"))


@query(f"""with ix as (select {NORM.format('p_name')} as key, min('p' || p_partkey) as slug from part group by 1),
  pr as (select distinct upper(replace(p_name, ' ', '--')) as name from part) select name, slug from pr join ix on ix.key = {NORM.format('name')}""")
def exact_lookup(v):
    return R.exact_lookup(v.part.select(F.upper(F.replace("p_name", F.lit(" "), F.lit("--"))).alias("name")).distinct(), named_parts(v))


@query(f"""with ix as (select {NORM.format('p_name')} as key, min('p' || p_partkey) as slug from part group by 1),
  pr as (select distinct p_name || 's' as name from part union select 'quite another thing'),
  hit as (select name, {NORM.format('name')} as k, ix.slug from pr left join ix on ix.key = {NORM.format('name')})
  select name, coalesce(slug, (select min(slug) from ix where ix.key || 's' = k)) as slug from hit""")
def fuzzy_lookup_plural(v):
    """Plural names; their only matches are the singular and names similar enough."""
    probes = v.part.select(F.concat("p_name", F.lit("s")).alias("name")).distinct().union(v.spark.sql("select 'quite another thing' as name"))
    return R.fuzzy_lookup(probes, named_parts(v))


ORACLE_SQL["fuzzy_lookup_plural"] = f"""with ix as (select {NORM.format('p_name')} as key, min('p' || p_partkey) as slug from part group by 1),
  pr as (select distinct p_name || 's' as name from part union select 'quite another thing'), pp as (select name, {NORM.format('name')} as key from pr),
  pk as (select distinct key from (select key from ix union select key from pp)), {SIGNATURES}, {MATCHES},
  near as (select p.name, min(ix.slug) as slug from pp p join mp on mp.a = p.key or mp.b = p.key join ix on ix.key = case when mp.a = p.key then mp.b else mp.a end group by p.name)
  select p.name, coalesce(ix.slug, near.slug) as slug from pp p left join ix on ix.key = p.key left join near on near.name = p.name"""


@query(f"""with k as (select distinct {NORM.format('s_name')} as key from supplier), s as (select key, regexp_replace(key, '[0-9]+', '#', 'g') as stem, array_to_string(regexp_extract_all(key, '[0-9]+'), ',') as n from k)
  select x.stem, (select count(*) from s where stem = x.stem)::bigint as keys, count(y.key)::bigint as pairs from s x left join s y on y.stem = x.stem and y.key > x.key and y.n <> x.n group by x.stem""")
def numeric_guard_blocked(v):
    return R.numeric_blocked(v.supplier.select(T.normalize_label(F.col("s_name")).alias("key")).distinct())


@query(f"""with k as (select distinct {NORM.format('p_name')} as key from part union select distinct {NORM.format("p_name || 's'")} from part)
  select x.key as short, y.key as long from k x join k y on x.key = substr(y.key, 1, length(y.key) - 1) and x.key <> '' where regexp_extract_all(x.key, '[0-9]+') = regexp_extract_all(y.key, '[0-9]+')""")
def suffix_variants(v):
    k = v.part.select("p_name").union(v.part.select(F.concat("p_name", F.lit("s"))))
    return R.suffix_pairs(k.select(T.normalize_label(F.col("p_name")).alias("key")).distinct())


@query("""with q as (select 'concept' as type, 'p' || p_partkey as a, 'p' || (p_partkey + 1) as b from part), old as (select a, b from q where substr(a, 2)::int % 5 = 0)
  select type, a as slug_a, b as slug_b, 'pending' as status from q where not exists (select 1 from old where old.a = q.a and old.b = q.b)""")
def merge_candidates(v):
    found = v.part.select(F.lit("concept").alias("type"), F.concat(F.lit("p"), "p_partkey").alias("slug_a"), F.concat(F.lit("p"), F.col("p_partkey") + 1).alias("slug_b"))
    back = found.select("type", F.col("slug_b").alias("slug_a"), F.col("slug_a").alias("slug_b"))
    queue = back.filter(F.substring("slug_b", 2, 20).cast("int") % 5 == 0).withColumn("status", F.lit("rejected"))
    return R.new_candidates(found.unionByName(found), queue)


PAIRS = "select 's' || s_suppkey as survivor, 's' || (s_suppkey + 1) as loser from supplier where s_suppkey % 2 = 1 and s_suppkey + 1 in (select s_suppkey from supplier)"


@query(f"""{NODES}, mg as ({PAIRS}), em as (select * from mentions where node_type = 'entity'),
  own as (select distinct node_slug, paper_slug from em)
  select node_slug, paper_slug, concept_slug from em where node_slug not in (select loser from mg)
  union all select mg.survivor, em.paper_slug, em.concept_slug from em join mg on em.node_slug = mg.loser
    where not exists (select 1 from own where own.node_slug = mg.survivor and own.paper_slug is not distinct from em.paper_slug)""")
def execute_merge_sources(v):
    s = v.supplier.select("s_suppkey")
    merges = s.filter("s_suppkey % 2 = 1").select((F.col("s_suppkey") + 1).alias("next"), F.concat(F.lit("s"), "s_suppkey").alias("survivor"))
    merges = merges.join(s.select(F.col("s_suppkey").alias("next")), "next", "left_semi").select("survivor", F.concat(F.lit("s"), "next").alias("loser"))
    m = v.mentions.filter("node_type = 'entity'").withColumn("ord", F.lit(0))
    return R.merge_sources(m, merges).select("node_slug", "paper_slug", "concept_slug")


@query(f"""with mg as ({PAIRS}), n as (select 's' || s_suppkey as slug, s_name as label, 'x' || (s_suppkey % 7) as alias from supplier)
  select n.slug, case when l.slug is null then n.alias else array_to_string(list_sort(list_distinct([n.alias, l.label, l.alias])), '|') end as aliases, r.survivor as redirect_to, l.slug as merged_from
  from n left join mg on mg.survivor = n.slug left join n l on l.slug = mg.loser left join mg r on r.loser = n.slug""")
def execute_merge_aliases(v):
    s = v.supplier
    n = s.select(F.concat(F.lit("s"), "s_suppkey").alias("slug"), F.col("s_name").alias("display_label"), F.array(F.concat(F.lit("x"), F.col("s_suppkey") % 7)).alias("aliases"), F.lit(None).cast("array<string>").alias("merged_from"), F.lit("").alias("user_notes"), F.lit(None).cast("string").alias("redirect_to"))
    k = s.select("s_suppkey")
    merges = k.filter("s_suppkey % 2 = 1").select((F.col("s_suppkey") + 1).alias("next"), F.concat(F.lit("s"), "s_suppkey").alias("survivor"))
    merges = merges.join(k.select(F.col("s_suppkey").alias("next")), "next", "left_semi").select("survivor", F.concat(F.lit("s"), "next").alias("loser"))
    out = R.merge_nodes(n, merges, "2024-01-01")
    return out.select("slug", F.array_join("aliases", "|").alias("aliases"), "redirect_to", F.col("merged_from")[0].alias("merged_from"))


# ---- store ----
CHAINED = """mg as (select ((p_partkey & -p_partkey) * 1000000000 + p_partkey)::bigint as seq, p_partkey & (p_partkey - 1) as up, p_partkey as p from part where p_partkey % 8 <> 0 and p_partkey & (p_partkey - 1) > 0),
  tr(p, root, path) as (select p_partkey, p_partkey, []::bigint[] from part where p_partkey not in (select p from mg) and p_partkey in (select up from mg)
    union all select mg.p, tr.root, list_append(tr.path, mg.seq) from tr join mg on mg.up = tr.p)"""


def chained(v: Views) -> DataFrame:
    """Parts in groups of eight: each goes to the one without its lowest bit, odd ones first, so most survivors lose later."""
    from .operators import chains as CH

    p, slug = F.col("p_partkey").cast("long"), lambda c: F.concat(F.lit("p"), c)
    up = p.bitwiseAND(p - 1)
    m = v.part.filter((p % 8 != 0) & (up > 0))
    return CH.forest(m.select((p.bitwiseAND(-p) * 1_000_000_000 + p).alias("seq"), slug(up).alias("survivor"), slug(p).alias("loser")))


@query(f"""with recursive {CHAINED}, n as (select p_partkey as p, p_name || ' ' || p_partkey as label, 'x' || (p_partkey % 7) as alias, case when p_partkey % 3 = 0 then 'n' || p_partkey else '' end as note from part),
  el as (select tr.root, tr.path, n.* from tr join n using (p)),
  al as (select root, array_to_string(list_sort(list_distinct(flatten(list(case when path = [] then [alias] else [alias, label] end)))), '|') as aliases,
    string_agg('p' || p, '|' order by path) filter (path <> []) as merged_from from el group by root),
  sub as (select a.root, a.path, a.note, exists (select 1 from el b where b.root = a.root and b.note <> '' and b.path[1:len(a.path)] = a.path) as says from el a),
  nt as (select root, string_agg(case when path = [] then note when says then chr(10) || chr(10) || '--- merged 2024-01-01 ---' || chr(10) || chr(10) || note else '' end, '' order by path) as notes from sub group by root)
  select 'p' || n.p as slug, coalesce(al.aliases, n.alias) as aliases, al.merged_from, coalesce(nt.notes, n.note) as user_notes, case when tr.path <> [] then 'p' || tr.root end as redirect_to
  from n left join al on al.root = n.p left join nt on nt.root = n.p left join tr on tr.p = n.p""")
def execute_merges_chained(v):
    """Nodes after merges whose survivors lose in later ones."""
    from .operators import chains as CH

    p = F.col("p_partkey")
    nodes = v.part.select(
        F.concat(F.lit("p"), p).alias("slug"), F.concat("p_name", F.lit(" "), p).alias("display_label"), F.array(F.concat(F.lit("x"), p % 7)).alias("aliases"), F.lit(None).cast("array<string>").alias("merged_from"),
        F.when(p % 3 == 0, F.concat(F.lit("n"), p)).otherwise("").alias("user_notes"), F.lit(None).cast("string").alias("redirect_to"))
    out = CH.merge_nodes(nodes, chained(v), "2024-01-01")
    return out.select("slug", F.array_join("aliases", "|").alias("aliases"), F.array_join("merged_from", "|").alias("merged_from"), "user_notes", "redirect_to")


@query(f"""with recursive {CHAINED}, m as (select l_partkey as p, 'o' || (l_orderkey % 50) as paper_slug, l_orderkey::bigint as ord from lineitem),
  j as (select m.*, tr.root, tr.path, min(tr.path) over (partition by tr.root, paper_slug) as least from m join tr using (p))
  select 'p' || root as node_slug, paper_slug, (row_number() over (partition by root order by path, ord, paper_slug) - 1)::bigint as ord from j where path = least
  union all select 'p' || p, paper_slug, ord from m where p not in (select p from tr)""")
def execute_merges_chained_sources(v):
    """Mentions after the same merges, in the order in which the last survivors hold them."""
    from .operators import chains as CH

    o = F.col("l_orderkey").cast("long")
    mentions = v.lineitem.select(F.concat(F.lit("p"), "l_partkey").alias("node_slug"), F.concat(F.lit("o"), o % 50).alias("paper_slug"), o.alias("ord"))
    return CH.merge_mentions(mentions, chained(v))


@query(f"""{BASE} select from_type, from_slug, rel_type, to_type, to_slug,
  coalesce(first(nullif(rationale, '') order by paper_slug, rationale) filter (rationale <> ''), '') as rationale,
  array_to_string(list_sort(list_distinct(list(paper_slug))), '|') as sources from relations_raw group by all""")
def relation_upsert(v):
    return ST.upsert_relations(v.relations_raw).withColumn("sources", F.array_join("sources", "|"))


ORACLE_SQL["relation_upsert"] = ORACLE_SQL["relation_upsert"].replace("group by all", "group by from_type, from_slug, rel_type, to_type, to_slug")


@query(f"""{BASE}, r as (select *, rel_type in (select rel_type from relation_types where "symmetric") and (from_type > to_type or (from_type = to_type and from_slug > to_slug)) as swap from relations_raw)
  select case when swap then to_type else from_type end as from_type, case when swap then to_slug else from_slug end as from_slug, rel_type,
  case when swap then from_type else to_type end as to_type, case when swap then from_slug else to_slug end as to_slug, rationale, paper_slug from r""")
def relation_symmetric(v):
    return ST.symmetric(v.relations_raw, v.relation_types)


@query(f"{BASE} select * from relations_raw where not (from_type = 'concept' and from_slug like 'p1%') and not (to_type = 'concept' and to_slug like 'p1%')")
def remove_relations_targeting(v):
    gone = v.nodes.filter("node_type = 'concept' and slug like 'p1%'")
    return ST.delete_nodes(v.nodes, v.mentions, v.relations_raw, gone)[2]


MENTIONS = "mm as (select distinct node_type, node_slug, paper_slug, null::varchar as paper_title, concept_slug from mentions)"


def all_mentions(v: Views) -> DataFrame:
    return v.mentions.distinct().select("node_type", "node_slug", "paper_slug", F.lit(None).cast("string").alias("paper_title"), "concept_slug")


@query(f"""{NODES}, {MENTIONS}, rq as (select 'concept' as node_type, slug as node_slug, 'o1' as paper_slug, 'one' as paper_title from concepts where slug like 'p2%'),
  up as (select node_type, node_slug, paper_slug, paper_title, case when node_type = 'concept' and node_slug like 'p2%' and paper_slug = 'o1' then null else concept_slug end as concept_slug from mm
    union all select node_type, node_slug, paper_slug, paper_title, null from rq where not exists (select 1 from mm where mm.node_type = 'concept' and mm.node_slug = rq.node_slug and mm.paper_slug = 'o1'))
  select node_type, node_slug, case when node_type = 'entity' and paper_slug is null and concept_slug in (select node_slug from rq) then 'o1' else paper_slug end as paper_slug,
    case when node_type = 'entity' and paper_slug is null and concept_slug in (select node_slug from rq) then 'one' else paper_title end as paper_title, concept_slug from up""")
def link_node(v):
    rq = v.concepts.filter("slug like 'p2%'").select(F.lit("concept").alias("node_type"), F.col("slug").alias("node_slug"), F.lit("o1").alias("paper_slug"), F.lit("one").alias("paper_title"), F.lit(None).cast("string").alias("concept_slug"))
    return ST.link(all_mentions(v), rq)


@query(f"""{NODES}, {MENTIONS} select node_type, node_slug, case when node_type = 'entity' and paper_slug is null and concept_slug like 'p3%' then 'o5' else paper_slug end as paper_slug,
  case when node_type = 'entity' and paper_slug is null and concept_slug like 'p3%' then 'five' else paper_title end as paper_title, concept_slug from mm""")
def propagate_paper(v):
    links = all_mentions(v).filter("concept_slug like 'p3%'").select(F.col("concept_slug").alias("node_slug"), F.lit("o5").alias("paper_slug"), F.lit("five").alias("paper_title")).distinct()
    return ST.propagate(all_mentions(v), links)


@query(f"""{NODES}, mm as (select distinct * from mentions), rq as (select distinct node_slug, paper_slug from concept_mentions where node_slug like '%3'
    union select distinct concept_slug, paper_slug from entity_mentions where concept_slug like 'p%3' and paper_slug is not null),
  l as (select * from mm where not (node_type = 'concept' and exists (select 1 from rq where rq.node_slug = mm.node_slug and rq.paper_slug = mm.paper_slug))),
  j as (select l.*, node_type = 'entity' and exists (select 1 from rq where rq.node_slug = l.concept_slug and rq.paper_slug = l.paper_slug) as cut from l)
  select distinct node_type, node_slug, case when not cut then paper_slug end as paper_slug, concept_slug from j
  where not (cut and exists (select 1 from j o where not o.cut and o.node_type = j.node_type and o.node_slug = j.node_slug and o.concept_slug = j.concept_slug))""")
def unlink_paper(v):
    a = v.concept_mentions.filter("node_slug like '%3'").select("node_slug", "paper_slug")
    b = v.entity_mentions.filter("concept_slug like 'p%3' and paper_slug is not null").select(F.col("concept_slug").alias("node_slug"), "paper_slug")
    return ST.unlink_paper(v.mentions.distinct(), a.union(b).distinct().withColumn("node_type", F.lit("concept")))


@query(f"{NODES} select * from mentions where not (node_type = 'entity' and concept_slug is not null and concept_slug like 'p1%')")
def unlink_concept(v):
    rq = v.entity_mentions.filter("concept_slug like 'p1%'").select("node_slug", "concept_slug").distinct()
    return ST.unlink_concept(v.mentions, rq)


@query(f"""{NODES}, l as (select * from mentions where paper_slug is null or paper_slug not like 'o1%')
  select distinct node_type, node_slug, not exists (select 1 from l where l.node_type = m.node_type and l.node_slug = m.node_slug) as deleted from mentions m where paper_slug like 'o1%'""")
def remove_source(v):
    return ST.remove_paper(v.mentions, v.papers.filter("slug like 'o1%'").select(F.col("slug").alias("paper_slug")))[1]


@query(f"""{NODES}, g as (select 'concept' as node_type, slug from concepts where slug like 'p5%' union select 'entity', node_slug from entity_mentions where concept_slug in (select slug from concepts where slug like 'p5%'))
  select node_type, slug, display_label from nodes n where not exists (select 1 from g where g.node_type = n.node_type and g.slug = n.slug)""")
def delete_cascade(v):
    gone = v.nodes.filter("node_type = 'concept' and slug like 'p5%'")
    return ST.delete_nodes(v.nodes, v.mentions, v.relations_raw, gone, cascade=True)[0]


@query("select conv_id, string_agg(text, chr(10) order by turn) as notes, rtrim(string_agg(text, chr(10) order by turn)) || chr(10) || chr(10) || 'added' as new_notes from conversations group by conv_id")
def user_notes_append(v):
    c = v.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("notes"))
    return c.withColumn("new_notes", ST.append_note(F.col("notes"), F.lit("added")))


@query(f"""{NODES}, rq as (select 's' || s_suppkey as node_slug, 'p' || (s_suppkey * 3) as concept_slug from supplier), cp as (select distinct node_slug as concept_slug, paper_slug from concept_mentions)
  select 'entity' as node_type, rq.node_slug, cp.paper_slug, rq.concept_slug from rq left join cp using (concept_slug)""")
def linked_papers_fan_out(v):
    rq = v.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("node_slug"), F.concat(F.lit("p"), F.col("s_suppkey") * 3).alias("concept_slug"))
    return ST.fan_out(v.mentions, rq)


@query(f"""with ix as (select {NORM.format('p_name')} as key, min('p' || p_partkey) as slug from part group by 1), rq as (select distinct upper(p_name) as label from part union select 'entirely new words' union select 'p1')
  select label, case when label = 'p1' then 'p1' else slug end as slug, case when label = 'p1' then 'same_slug' when slug is not null then 'similar' end as conflict from rq left join ix on ix.key = {NORM.format('label')}""")
def create_node_conflicts(v):
    rq = v.part.select(F.upper("p_name").alias("label")).distinct().union(v.spark.sql("select 'entirely new words'")).union(v.spark.sql("select 'p1'"))
    nodes = named_parts(v).withColumn("slug", F.when(F.col("slug") == "p1", "p-1").otherwise(F.col("slug")))
    return ST.creation_conflicts(rq, nodes)


ORACLE_SQL["create_node_conflicts"] = f"""with ix as (select {NORM.format('p_name')} as key, min(case when p_partkey = 1 then 'p-1' else 'p' || p_partkey end) as slug from part group by 1),
  rq as (select distinct upper(p_name) as label from part union select 'entirely new words' union select 'p1')
  select label, case when label = 'p1' then 'p-1' else slug end as slug, case when label = 'p1' then 'same_slug' when slug is not null then 'similar' end as conflict from rq left join ix on ix.key = {NORM.format('label')}"""


@query(f"""{BASE} select 'folder' as kind, folder_id as container, paper_slug from folder_papers where paper_slug <> 'o2'
  union all select 'brain', brain_id, paper_slug from brain_papers where paper_slug <> 'o2' union all select 'brain', 'b4', 'o2'""")
def set_paper_brain(v):
    f, b, _ = SC.set_paper_brain(v.folder_papers, v.brain_papers, v.brains, "o2", "b4")
    return f.select(F.lit("folder").alias("kind"), F.col("folder_id").alias("container"), "paper_slug").unionByName(b.select(F.lit("brain").alias("kind"), F.col("brain_id").alias("container"), "paper_slug"))


@query(f"{BASE} select id, name from folders order by name")
def alphabetical_folders(v):
    return SC.alphabetical(v.folders).select("id", "name")


@query(f"{BASE} select id, name, row_number() over (order by name, id) as place from folders")
def alphabetical_places(v):
    """The order itself, as a number; folders are few."""
    return SC.with_places(v.folders).select("id", "name", "place")


# ---- text ----
@query(r"select o_orderkey, coalesce(nullif(trim(substr(trim(regexp_replace(regexp_replace(o_orderpriority || ': a/b – ' || o_orderstatus, '[^A-Za-z0-9 \-_.,()'']', ' ', 'g'), ' +', ' ', 'g')), 1, 70)), ''), 'untitled') as slug from orders")
def slugify_titles(v):
    return v.orders.select("o_orderkey", T.slugify(F.concat("o_orderpriority", F.lit(": a/b – "), "o_orderstatus")).alias("slug"))


@query("select doc_id, first_id from (select doc_id, min(doc_id) over (partition by text) as first_id from documents) where doc_id <> first_id")
def text_hash_duplicates(v):
    known = v.documents.select(F.col("doc_id").alias("slug"), F.sha2("text", 256).alias("text_hash"))
    found = vault.duplicates_by_hash(known, v.documents.select(F.col("doc_id").alias("id"), "text"))
    return found.filter("id <> slug").select(F.col("id").alias("doc_id"), F.col("slug").alias("first_id"))


@query('''select page_id, len(regexp_extract_all(html, '<a href="([^"]*)"', 1))::bigint as n_links, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))), '|') as links from pages''')
def html_links(v):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return v.pages.select("page_id", F.size(links).cast("long").alias("n_links"), F.array_join(F.array_sort(F.array_distinct(links)), "|").alias("links"))


@query(f"{BASE}, {{notes}} select slug, t as target from (select slug, unnest(list_distinct(list_transform(regexp_extract_all(body, '!?\\[\\[([^\\]|#]+)(?:\\|[^\\]]+)?\\]\\]', 1), lambda x: trim(x)))) as t from notes)".replace("{notes}", NOTES))
def wikilinks(v):
    return v.notes.select("slug", F.explode(T.wikilinks(F.col("body"))).alias("target"))


@query(f"{BASE}, {{notes}} select slug, unnest(regexp_extract_all(body, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1)) as path from notes".replace("{notes}", NOTES))
def md_images(v):
    return v.notes.select("slug", F.explode(T.md_images(F.col("body"))).alias("path"))


@query(f"{BASE}, {{notes}} select distinct n.slug as source, w.t as target, 'link' as type from (select slug, unnest(regexp_extract_all(body, '!?\\[\\[([^\\]|#]+)(?:\\|[^\\]]+)?\\]\\]', 1)) as x from notes) n, (select slug as t from papers) w where trim(n.x) = w.t".replace("{notes}", NOTES))
def wikilink_edges(v):
    return G.wikilink_edges(v.notes)


ATTACHED = """att as (select slug as id, slug as owner_slug, 'note' as owner_type, unnest(list_distinct(list_concat(list_filter(list_transform(regexp_extract_all(body, '!?\\[\\[([^\\]|#]+)(?:\\|[^\\]]+)?\\]\\]', 1), lambda x: trim(x)), lambda x: lower(x) like '%.png'),
    regexp_extract_all(body, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1)))) as src from notes
  union all select id, slug, 'concept', unnest(regexp_extract_all(body, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1)) from node_bodies),
an as (select 'attachment:' || id || ':' || regexp_extract(src, '[^/]+$') as target, regexp_extract(src, '[^/]+$') as label, * from att)"""


def attachments(v: Views) -> tuple[DataFrame, DataFrame]:
    a, b = G.attachment_edges(v.notes.select(F.col("slug").alias("id"), "slug", "body")), G.attachment_edges(v.node_bodies, "concept")
    return a[0].unionByName(b[0]), a[1].unionByName(b[1])


@query(f"{BASE}, {{notes}}, {ATTACHED} select id as source, target, 'link' as type from an".replace("{notes}", NOTES))
def attachment_edges(v):
    return attachments(v)[1]


@query(f"{BASE}, {{notes}}, {ATTACHED} select target as id, label, 'attachment' as type, false as orphan, owner_type, owner_slug, min(src) as src from an group by target, label, owner_type, owner_slug".replace("{notes}", NOTES))
def attachment_nodes(v):
    return attachments(v)[0]


@query(f"""{EDGES}, {{notes}}, {ATTACHED}, wl as (select distinct n.slug as source, w.t as target from (select slug, unnest(regexp_extract_all(body, '!?\\[\\[([^\\]|#]+)(?:\\|[^\\]]+)?\\]\\]', 1)) as x from notes) n, (select slug as t from papers) w where trim(n.x) = w.t),
  every as (select 'edge' as kind, source as a, target as b, type, relation from (select *, null as relation from pe union all select *, null from te union all select source, target, type, relation from se
    union all select source, target, 'link', null from wl union all select id, target, 'link', null from an)
  union all select 'node', id, label, type, case when orphan then 'orphan' end from gn union all select distinct 'node', target, label, 'attachment', null from an)
  select kind, type, relation, count(*)::bigint as n, count(distinct a)::bigint as n_a, count(distinct b)::bigint as n_b from every group by kind, type, relation""".replace("{notes}", NOTES))
def build_graph(v):
    """The whole view in one call, summed up by kind."""
    nodes, edges = G.build(v.papers, v.concepts, v.entities, v.concept_mentions, v.entity_mentions, v.notes, v.node_bodies, v.relations_raw, v.relation_types)
    e = edges.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), "type", "relation")
    n = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b"), "type", F.when(F.col("orphan"), "orphan").alias("relation"))
    return e.unionByName(n).groupBy("kind", "type", "relation").agg(F.count("*").alias("n"), F.count_distinct("a").alias("n_a"), F.count_distinct("b").alias("n_b"))


@query("select doc_id, trim(replace(replace(text, '|', '\\|'), chr(10), ' ')) as cell from documents")
def table_cells(v):
    return v.documents.select("doc_id", T.table_cell(F.col("text")).alias("cell"))


@query(f"""{NODES}, s as (select node_slug, count(paper_slug)::bigint as n, string_agg('- [[' || paper_slug || '|' || paper_slug || ']]', chr(10) order by paper_slug) as l from concept_mentions group by node_slug)
  select slug, '# ' || display_label || chr(10) || chr(10) || '**Other names**: none' || chr(10) || chr(10) || '**Categories**: ' || category || chr(10) || chr(10) || '**Papers**: ' || coalesce(n, 0) || coalesce(chr(10) || l, '') as content
  from concepts left join s on s.node_slug = slug""")
def render_node_md(v):
    src = v.concept_mentions.groupBy(F.col("node_slug").alias("slug")).agg(F.array_sort(F.collect_list(F.struct(F.col("paper_slug").alias("slug"), F.lit(None).cast("string").alias("title")))).alias("sources"))
    c = v.concepts.join(src, "slug", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<struct<slug: string, title: string>>")))
    none = F.array().cast("array<string>")
    return c.select("slug", vault.render_node(F.col("display_label"), F.lit("concept"), none, F.array("category"), F.col("sources"), F.lit(None), F.lit(None)).alias("content"))


@query(r"""with d as (select doc_id, case when doc_id % 3 = 0 then text when doc_id % 3 = 1 then text || chr(10) || ' 7. References:' || chr(10) || lang || chr(10) || source
    else 'References' || chr(10) || text || chr(10) || 'Bibliography -' || chr(10) || text || chr(10) || lang end as t from documents),
  l as (select doc_id, t, string_split(t, chr(10)) as lines from d),
  i as (select doc_id, t, lines, min(i) as pos from (select doc_id, t, lines, unnest(range(len(lines) // 2 + 1, len(lines) + 1)) as i from l)
    where regexp_full_match(lines[i], '(?i)\s*(?:[0-9]{1,3}[\.\)]?\s*)?(references|bibliography)\s*[:\-]?\s*') and length(array_to_string(lines[i:], chr(10))) / greatest(length(t), 1) <= 0.4 group by all)
  select doc_id, length(k)::bigint as n, sha256(k) as digest from (select l.doc_id, case when pos is null then l.t else regexp_replace(array_to_string(l.lines[:pos - 1], chr(10)), '\s+$', '') end as k from l left join i using (doc_id))""")
def strip_references(v):
    late = F.concat("text", F.lit("\n 7. References:\n"), "lang", F.lit("\n"), "source")
    early = F.concat(F.lit("References\n"), "text", F.lit("\nBibliography -\n"), "text", F.lit("\n"), "lang")
    kept = T.strip_references(F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, late).otherwise(early))
    return v.documents.select("doc_id", kept.alias("k")).select("doc_id", F.length("k").cast("long").alias("n"), F.sha2("k", 256).alias("digest"))


# ---- retrieval ----
VEC = """vec as (select case when vec_id % 2 = 0 then 'concept' else 'entity' end as node_type, 'v' || vec_id as node_slug, embedding::double[] as e from embeddings),
qq as (select embedding::double[] as q from embeddings where vec_id = (select min(vec_id) from embeddings)),
sc as (select node_type, node_slug, round(list_cosine_similarity(e, q), 6) as score from vec, qq),
top as (select * from (select *, row_number() over (partition by node_type order by score desc, node_slug) as n from sc) where n <= 10),
vh as (select node_type, node_slug, score, row_number() over (order by score desc, node_type, node_slug) as rank from top)"""
ASK = "the nation of erthan"
BM = """tok as (select id, node_type, node_slug, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as t from dd),
st as (select count(*)::double as n_docs, avg(len(t)) as avg_len from tok),
tf as (select id, len(t) as len, w as term, len(list_filter(t, lambda x: x = w)) as tf from tok, (select unnest(['the', 'nation', 'of', 'erthan']) as w) where len(list_filter(t, lambda x: x = w)) > 0),
df as (select term, count(*) as df from tf group by term),
bs as (select id, round(sum(ln(1 + (n_docs - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (1 - 0.75::double + 0.75::double * len / avg_len))), 6) as score from tf join df using (term), st group by id),
bh as (select id, score, row_number() over (order by score desc, id) as rank from bs)"""
DOCS = "dd as (select doc_id as id, case when doc_id % 2 = 0 then 'concept' else 'entity' end as node_type, 'v' || doc_id as node_slug, text from documents)"


def vectors(v: Views) -> DataFrame:
    return v.embeddings.select(F.when(F.col("vec_id") % 2 == 0, "concept").otherwise("entity").alias("node_type"), F.concat(F.lit("v"), "vec_id").alias("node_slug"), "embedding")


def question(v: Views) -> DataFrame:
    return v.embeddings.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))


def documents(v: Views) -> DataFrame:
    return v.documents.select(F.when(F.col("doc_id") % 2 == 0, "concept").otherwise("entity").alias("node_type"), F.concat(F.lit("v"), "doc_id").alias("node_slug"), "text", F.col("doc_id").alias("id"))


@query(f"with {VEC} select * from vh")
def vector_topk(v):
    return SE.vector_hits(vectors(v), question(v))


@query(f"with {DOCS}, {BM} select * from bh where rank <= 10")
def fulltext_bm25(v):
    return SE.bm25(documents(v), ASK)


RRF = """both_lists as (select node_type, node_slug, rank from vh union all select node_type, node_slug, row_number() over (order by score desc, node_type, node_slug) from (select node_type, node_slug, score from bs join dd using (id) {where} order by score desc, node_type, node_slug limit 10)),
fused as (select node_type, node_slug, round(sum(1.0::double / (60 + rank)), 9) as score from both_lists group by all)
select *, row_number() over (order by score desc, node_type, node_slug) as rank from fused qualify rank <= 10"""


@query(f"with {VEC}, {DOCS}, {BM}, {RRF.format(where='')}")
def rrf_fusion(v):
    return SE.hybrid(vectors(v), question(v), documents(v).drop("id"), ASK)


BRAIN = "nbr as (select 'concept' as node_type, 'v' || vec_id as node_slug from embeddings where vec_id % 3 = 0 union all select 'entity', 'v' || vec_id from embeddings where vec_id % 3 = 0)"


@query(f"""with {VEC.replace('vh as (', 'vh0 as (')}, {BRAIN}, vh as (select node_type, node_slug, row_number() over (order by rank) as rank from vh0 semi join nbr using (node_type, node_slug)),
  {DOCS.replace('from documents)', "from documents where doc_id in (select vec_id from embeddings where vec_id % 3 = 0))")}, {BM}, {RRF.format(where='')}""")
def hybrid_search_brain(v):
    k = v.embeddings.filter("vec_id % 3 = 0").select(F.concat(F.lit("v"), "vec_id").alias("node_slug"), F.array(F.lit("b1")).alias("brain_ids"))
    ids = k.withColumn("node_type", F.explode(F.array(F.lit("concept"), F.lit("entity"))))
    return SE.hybrid(vectors(v), question(v), documents(v).drop("id"), ASK, brain_ids=ids, brain="b1")


LINKS = f"""{EDGES}, ge as (select src_type, src_slug, dst_type, dst_slug, null::varchar as relation from mirror
  union all select distinct from_type, from_slug, to_type, to_slug, rel_type from relations_raw r
    where exists (select 1 from nodes n where n.node_type = r.from_type and n.slug = r.from_slug) and exists (select 1 from nodes n where n.node_type = r.to_type and n.slug = r.to_slug)),
bw as (select src_type as seed_type, src_slug as seed_slug, dst_type as node_type, dst_slug as node_slug, relation, case when relation is not null then 'outgoing' end as direction from ge
  union all select dst_type, dst_slug, src_type, src_slug, relation, case when relation is not null then 'incoming' end from ge),
seeds as (select 'entity' as seed_type, 's' || s_suppkey as seed_slug from supplier where s_suppkey % 50 = 0 union all select 'concept', 'p' || p_partkey from part where p_partkey % 50 = 0)"""


def graph_links(v: Views) -> DataFrame:
    a = G.mirror_edges(v.papers, v.concepts, v.entities, v.concept_mentions, v.entity_mentions).withColumn("relation", F.lit(None).cast("string"))
    r = v.relations_raw.select(F.col("from_type").alias("src_type"), F.col("from_slug").alias("src_slug"), F.col("to_type").alias("dst_type"), F.col("to_slug").alias("dst_slug"), F.col("rel_type").alias("relation")).distinct()
    side = lambda t, s: v.nodes.select(F.col("node_type").alias(t), F.col("slug").alias(s))
    return a.unionByName(r.join(side("src_type", "src_slug"), ["src_type", "src_slug"], "left_semi").join(side("dst_type", "dst_slug"), ["dst_type", "dst_slug"], "left_semi"))


def seeds(v: Views) -> DataFrame:
    """What searches start from: every id divisible by 50."""
    s = v.supplier.filter("s_suppkey % 50 = 0").select(F.lit("entity").alias("seed_type"), F.concat(F.lit("s"), "s_suppkey").alias("seed_slug"))
    return s.unionByName(v.part.filter("p_partkey % 50 = 0").select(F.lit("concept").alias("seed_type"), F.concat(F.lit("p"), "p_partkey").alias("seed_slug")))


@query(f"{LINKS} select bw.* from bw join seeds using (seed_type, seed_slug)")
def neighbors_all(v):
    return SE.neighbors_all(seeds(v), graph_links(v)).select("seed_type", "seed_slug", "node_type", "node_slug", "relation", "direction")


TYPE_VEC = "tv as (select t.rel_type, e.embedding::double[] as e from (select rel_type, row_number() over (order by rel_type) as i from relation_types) t join (select embedding, row_number() over (order by vec_id) + 0 as i from embeddings) e using (i))"
ROUTE = "qq as (select embedding::double[] as q from embeddings order by vec_id desc limit 1), rt as (select rel_type, round(list_cosine_similarity(e, q), 6) as type_score from tv, qq order by 2 desc, 1 limit 3)"


def type_vectors(v: Views) -> DataFrame:
    few = v.embeddings.orderBy("vec_id").limit(12).select(F.row_number().over(SE.Window.orderBy("vec_id")).alias("i"), "embedding")
    return v.relation_types.select(F.row_number().over(SE.Window.orderBy("rel_type")).alias("i"), "rel_type").join(few, "i").select("rel_type", "embedding")


def last_question(v: Views) -> DataFrame:
    return v.embeddings.orderBy(F.desc("vec_id")).limit(1).select(F.col("embedding").alias("q"))


@query(f"{BASE}, {TYPE_VEC}, {ROUTE} select * from rt")
def route_relation_types(v):
    return SE.route(type_vectors(v), last_question(v))


NODE_VEC = """nv as (select n.node_type, n.slug as node_slug, e.embedding::double[] as e from nodes n join embeddings e
  on e.vec_id = (case when n.node_type = 'concept' then substr(n.slug, 2)::int % 400 else substr(n.slug, 2)::int % 97 end))"""
ROUTED = """nr as (select *, count(*) over (partition by seed_type, seed_slug) as total, row_number() over (partition by seed_type, seed_slug order by score desc, node_type, node_slug, relation, direction) as n
  from (select bw.seed_type, bw.seed_slug, node_type, node_slug, relation, direction, round(type_score * list_cosine_similarity(e, q), 4) as score
    from bw join rt on rt.rel_type = bw.relation join nv using (node_type, node_slug), qq{join}))"""


def node_vectors(v: Views) -> DataFrame:
    n = v.nodes.withColumn("vec_id", F.expr("substring(slug, 2)").cast("int") % F.when(F.col("node_type") == "concept", 400).otherwise(97))
    return n.join(v.embeddings, "vec_id").select("node_type", F.col("slug").alias("node_slug"), "embedding")


@query(f"{LINKS}, {TYPE_VEC}, {ROUTE}, {NODE_VEC}, {ROUTED.format(join='')} select nr.* from nr join seeds using (seed_type, seed_slug) where n <= 5")
def neighbors_routed(v):
    return SE.neighbors_routed(seeds(v), graph_links(v), SE.route(type_vectors(v), last_question(v)), node_vectors(v), last_question(v))


@query(f"""{LINKS}, {TYPE_VEC}, {ROUTE}, {NODE_VEC}, {ROUTED.format(join='')},
  via as (select distinct seed_type, seed_slug, node_type as via_type, node_slug as via_slug from nr join seeds using (seed_type, seed_slug) where n <= 2)
  select via.*, nr.node_type, nr.node_slug, nr.relation, nr.direction, nr.score from via join nr on nr.seed_type = via.via_type and nr.seed_slug = via.via_slug where nr.n <= 5""")
def neighbors_hop2(v):
    routed, q, vec, links = SE.route(type_vectors(v), last_question(v)), last_question(v), node_vectors(v), graph_links(v)
    first = SE.neighbors_routed(seeds(v), links, routed, vec, q)
    return SE.second_hop(first, links, routed, vec, q, 2).select("seed_type", "seed_slug", "via_type", "via_slug", "node_type", "node_slug", "relation", "direction", "score")


@query(f"""{LINKS}, {VEC.replace("'v' || vec_id", "'p' || vec_id").replace("case when vec_id % 2 = 0 then 'concept' else 'entity' end", "'concept'")},
  hits as (select node_type as seed_type, node_slug as seed_slug, rank from vh)
  select h.seed_type, h.seed_slug, h.rank, bw.node_type, bw.node_slug, bw.relation, bw.direction from hits h left join bw using (seed_type, seed_slug)""")
def hybrid_search(v):
    """Vector hits with all that surrounds them, in one plan."""
    vec = v.embeddings.select(F.lit("concept").alias("node_type"), F.concat(F.lit("p"), "vec_id").alias("node_slug"), "embedding")
    hits = SE.vector_hits(vec, question(v)).select(F.col("node_type").alias("seed_type"), F.col("node_slug").alias("seed_slug"), "rank")
    around = SE.neighbors_all(hits, graph_links(v))
    return hits.join(around, ["seed_type", "seed_slug"], "left").select("seed_type", "seed_slug", "rank", "node_type", "node_slug", "relation", "direction")


SEARCH = f"""{LINKS}, {TYPE_VEC}, {ROUTE}, {NODE_VEC},
{VEC[VEC.index('sc as ('):].replace('from vec, qq', 'from nv, qq')}, {DOCS}, {BM}, {RRF[: RRF.index('select *, row_number')].format(where='').rstrip()},
hits as (select * from (select *, row_number() over (order by score desc, node_type, node_slug) as rank from fused) where rank <= 10), {ROUTED.format(join=' /*scope*/')}"""
AROUND = """select h.node_type, h.node_slug, h.score, h.rank,
  (select count(*) from bw where bw.seed_type = h.node_type and bw.seed_slug = h.node_slug and relation is null /*scope*/)::bigint as n_provenance,
  (select coalesce(max(total), 0) from nr where nr.seed_type = h.node_type and nr.seed_slug = h.node_slug)::bigint as total,
  (select string_agg(nr.node_type || ':' || nr.node_slug || ':' || relation || ':' || direction, ',' order by n) from nr where nr.seed_type = h.node_type and nr.seed_slug = h.node_slug and n <= 5) as best,
  (select count(*) from (select distinct node_type, node_slug from nr where nr.seed_type = h.node_type and nr.seed_slug = h.node_slug and n <= 2) v join nr x on x.seed_type = v.node_type and x.seed_slug = v.node_slug where x.n <= 5)::bigint as n_second,
  (select string_agg(rel_type, ',' order by rel_type) from rt) as routed_types
from hits h"""


def flat(found: DataFrame) -> DataFrame:
    """A search result, a row for each hit with counts and names of what surrounds it."""
    best = F.transform(F.array_sort("neighbors", lambda x, y: x["n"].cast("int") - y["n"].cast("int")), lambda x: F.concat_ws(":", x["node_type"], x["node_slug"], x["relation"], x["direction"]))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    count = lambda c: F.when(F.col(c).isNull(), F.lit(0).cast("long")).otherwise(size(c)).alias(f"n_{c}")
    return found.select("node_type", "node_slug", "score", F.col("rank").cast("long").alias("rank"), count("provenance"), F.col("total").cast("long").alias("total"), F.nullif(F.array_join(best, ","), F.lit("")).alias("best"),
                        count("second"), F.array_join("routed_types", ",").alias("routed_types"))


@query(f"{SEARCH} {AROUND}")
def graph_search(v):
    """The whole search: fused hits, their provenance, the best routed neighbours of each and a second hop, in one plan."""
    return flat(SE.search(ASK, last_question(v), node_vectors(v), documents(v).drop("id"), graph_links(v), type_vectors(v), mode="routed", hop2=2))


def third_brain(v: Views) -> DataFrame:
    """A brain of the nodes and papers whose number is divisible by 3."""
    part = lambda d, t, c, p: d.filter(F.col(c) % 3 == 0).select(F.lit(t).alias("node_type"), F.concat(F.lit(p), c).alias("node_slug"))
    rows = part(v.part, "concept", "p_partkey", "p").unionByName(part(v.supplier, "entity", "s_suppkey", "s")).unionByName(part(v.nation, "entity", "n_nationkey", "n")).unionByName(part(v.orders, "paper", "o_orderkey", "o"))
    return rows.withColumn("brain_ids", F.array(F.lit("b1")))


THIRD = """nb3 as (select 'concept' as node_type, 'p' || p_partkey as node_slug from part where p_partkey % 3 = 0 union all select 'entity', 's' || s_suppkey from supplier where s_suppkey % 3 = 0
  union all select 'entity', 'n' || n_nationkey from nation where n_nationkey % 3 = 0 union all select 'paper', 'o' || o_orderkey from orders where o_orderkey % 3 = 0)"""
IN_THIRD = " where (node_type, node_slug) in (select (node_type, node_slug) from nb3)"


@query(f"{LINKS}, {THIRD}, {TYPE_VEC}, {ROUTE}, {NODE_VEC}, {ROUTED.format(join=IN_THIRD)} select nr.* from nr join seeds using (seed_type, seed_slug) where n <= 5")
def neighbors_routed_brain(v):
    return SE.neighbors_routed(seeds(v), graph_links(v), SE.route(type_vectors(v), last_question(v)), node_vectors(v), last_question(v), brain="b1", brain_ids=third_brain(v))


@query(f"{LINKS}, {THIRD} select seed_type, seed_slug, node_type, node_slug from bw join seeds using (seed_type, seed_slug) where relation is null and (node_type, node_slug) in (select (node_type, node_slug) from nb3)")
def provenance_neighbors_brain(v):
    return SE.provenance_neighbors(seeds(v), graph_links(v), "b1", third_brain(v))


def in_third_brain(sql: str) -> str:
    """The SQL of a search, scoped: vector hits after their top-k, documents before theirs, neighbours before they are ranked."""
    ranked = "vh as (select node_type, node_slug, score, row_number() over (order by score desc, node_type, node_slug) as rank from top)"
    assert ranked in sql and DOCS in sql and LINKS in sql
    sql = sql.replace(ranked, ranked.replace("vh as", "vh0 as") + ", vh as (select node_type, node_slug, score, row_number() over (order by rank) as rank from vh0 semi join nb3 using (node_type, node_slug))")
    sql = sql.replace(DOCS, DOCS.replace("dd as", "dd0 as") + ", dd as (select dd0.* from dd0 semi join nb3 using (node_type, node_slug))")
    return sql.replace(LINKS, f"{LINKS}, {THIRD}").replace("/*scope*/", IN_THIRD)


@query(in_third_brain(SEARCH) + AROUND.replace("/*scope*/", IN_THIRD.replace(" where ", " and ").replace("(node_type, node_slug) in", "(bw.node_type, bw.node_slug) in")))
def graph_search_brain(v):
    """The same within a brain: hits, provenance, neighbours and the second hop."""
    return flat(SE.search(ASK, last_question(v), node_vectors(v), documents(v).drop("id"), graph_links(v), type_vectors(v), mode="routed", hop2=2, brain="b1", brain_ids=third_brain(v)))


@query(f"{BASE}, {TYPE_VEC} select rel_type, 1.0::double as type_score from tv where rel_type in ('USES', 'IS_A')")
def explicit_types(v):
    return SE.explicit_types(" USES, unknown,,IS_A ", type_vectors(v))


@query(r"""select o_orderkey, '# ' || o_orderpriority || ' | x' || chr(10) || chr(10) || '> **TL;DR**: ' || o_orderstatus || chr(10) || chr(10) || '## Problem and motivation' || chr(10) || '- ' || o_orderstatus || chr(10) || '- why'
  || chr(10) || chr(10) || '## Claims' || chr(10) || case when o_orderkey % 4 = 0 then '_none_' else '| # | Claim | Evidence |' || chr(10) || '|---|---|---|' || chr(10) || '| 1 | a\|' || o_custkey || ' |  |' end
  || chr(10) || chr(10) || '## Concepts and methods' || chr(10) || '| Concept | Description | Note |' || chr(10) || '|---|---|---|' || chr(10) || '| [[C' || o_custkey || ']] | d | n |' || chr(10)
  || '| [[E]] | m | ' || case when o_orderkey % 2 = 0 then 'C' || o_custkey else 'own' end || ' |' || chr(10) || chr(10) || '## Limitations' || chr(10) || 'few' as content from orders""")
def render_notes(v):
    """A note for each paper, from columns that look like an extraction."""
    d = v.orders.select(
        "o_orderkey", F.concat("o_orderpriority", F.lit(" | x")).alias("title"), F.col("o_orderstatus").alias("tldr"), F.array("o_orderstatus", F.lit("why")).alias("motivation"),
        F.when(F.col("o_orderkey") % 4 == 0, F.expr("cast(array() as array<struct<claim: string, evidence: string>>)")).otherwise(F.array(F.struct(F.concat(F.lit("a|"), "o_custkey").alias("claim"), F.lit(None).cast("string").alias("evidence")))).alias("claims"),
        F.array(F.struct(F.lit("c1").alias("id"), F.concat(F.lit("C"), "o_custkey").alias("label"), F.lit("d").alias("description"), F.lit("n").alias("note"))).alias("concepts"),
        F.array(F.struct(F.lit("E").alias("label"), F.when(F.col("o_orderkey") % 2 == 0, "c1").otherwise("zz").alias("concept_id"), F.lit("m").alias("description"), F.lit("own").alias("note"))).alias("entities"), F.lit("few").alias("limitations"),
    )
    return d.select("o_orderkey", vault.render_note(*(F.col(c) for c in d.columns[1:])).alias("content"))


# ---- requests on the store, over rich node rows ----
RICH = """rich as (select 'concept' as node_type, 'p' || p_partkey as slug, p_name || ' ' || p_partkey as display_label, [p_brand, 'x' || p_size] as aliases, 'd' as description, '' as note, [p_type] as categories,
  case when p_partkey % 5 = 0 then 'p' || (p_partkey - 1) end as redirect_to, 'own ' || p_partkey as user_notes, case when p_partkey % 3 > 0 then '2024-01-' || lpad((p_partkey % 28 + 1)::varchar, 2, '0') end as created_at from part)"""
SHOW = "select slug, display_label, array_to_string({aliases}, '|') as aliases, array_to_string({categories}, '|') as categories, {notes} as user_notes from rich"


def rich(v: Views) -> DataFrame:
    p = F.col("p_partkey")
    return v.part.select(
        F.lit("concept").alias("node_type"), F.concat(F.lit("p"), p).alias("slug"), F.concat("p_name", F.lit(" "), p).alias("display_label"), F.array(F.col("p_brand"), F.concat(F.lit("x"), "p_size")).alias("aliases"),
        F.lit("d").alias("description"), F.lit("").alias("note"), F.array("p_type").alias("categories"), F.when(p % 5 == 0, F.concat(F.lit("p"), p - 1)).alias("redirect_to"), F.concat(F.lit("own "), p).alias("user_notes"),
        F.when(p % 3 > 0, F.concat(F.lit("2024-01-"), F.lpad((p % 28 + 1).cast("string"), 2, "0"))).alias("created_at"),
    )


def shown(nodes: DataFrame) -> DataFrame:
    return nodes.select("slug", "display_label", F.array_join("aliases", "|").alias("aliases"), F.array_join("categories", "|").alias("categories"), "user_notes")


def show(aliases: str = "aliases", categories: str = "categories", notes: str = "user_notes", label: str = "display_label") -> str:
    return f"with {RICH} {SHOW.format(aliases=aliases, categories=categories, notes=notes)}".replace("select slug, display_label", f"select slug, {label} as display_label")


@query(show(aliases="case when slug = 'p7' then list_append(aliases, 'brand new name') else aliases end"))
def add_alias(v):
    return shown(ST.with_alias(rich(v), R.name_index(rich(v)), "concept", "p7", "brand new name"))


@query(show(aliases="case when slug = 'p7' then list_filter(aliases, lambda x: x not like 'x%') else aliases end"))
def remove_alias(v):
    size = v.part.filter("p_partkey = 7").select("p_size").first()[0]
    return shown(ST.without_alias(rich(v), "concept", "p7", f"x{size}"))


@query(show(aliases="case when slug = 'p7' then list_append(aliases, display_label) else aliases end", label="case when slug = 'p7' then 'A New Label' else display_label end"))
def rename_label(v):
    return shown(ST.renamed(rich(v), R.name_index(rich(v)), "concept", "p7", "A New Label"))


@query(show(categories="case when slug = 'p7' then list_append(categories, 'theory') else categories end"))
def add_category(v):
    from .schema import CONCEPT_CATEGORIES

    return shown(ST.with_category(rich(v), "p7", "theory", CONCEPT_CATEGORIES))


@query(show(categories="case when slug = 'p7' then []::varchar[] else categories end"))
def remove_category(v):
    kind = v.part.filter("p_partkey = 7").select("p_type").first()[0]
    return shown(ST.without_category(rich(v), "p7", kind))


@query(show(notes="case when slug = 'p7' then 'replaced' else user_notes end"))
def user_section(v):
    return shown(ST.with_user_notes(rich(v), "concept", "p7", "replaced"))


@query(f"with {RICH} select slug, display_label || chr(10) || 'd' || chr(10) || '' || chr(10) || user_notes as text from rich")
def index_texts(v):
    return rich(v).select("slug", SE.index_text(F.col("display_label"), F.col("description"), F.col("note"), F.col("user_notes")).alias("text"))


@query(f"{BASE} select rel_type, rel_type || ': ' || case rel_type when 'USES' then 'A uses B' else rel_type end as text from relation_types")
def relation_type_texts(v):
    return vault.type_texts(v.relation_types, v.spark.sql("select 'USES' as rel_type, 'A uses B' as description"))


@query("select p_partkey, case when p_partkey % 3 = 0 then p_type || '|more' when p_partkey % 3 = 1 then p_type else '' end as categories from part")
def migrate_categories(v):
    p = F.col("p_partkey")
    return v.part.select("p_partkey", F.array_join(ST.categories_of(F.when(p % 3 < 2, F.col("p_type")), F.when(p % 3 == 0, F.array("p_type", F.lit("more")))), "|").alias("categories"))


@query(f"{NODES}, mm as (select distinct * from mentions) select node_type, node_slug, paper_slug, case when node_type = 'entity' and paper_slug like 'o1%' and node_slug like 's%' then 'moved' else concept_slug end as concept_slug from mm")
def set_source_concept(v):
    rq = v.entity_mentions.filter("paper_slug like 'o1%' and node_slug like 's%'").select("node_slug", "paper_slug").distinct().withColumn("concept_slug", F.lit("moved"))
    return ST.with_source_concept(v.mentions.distinct(), rq)


@query(f"with {RICH} select slug from rich where redirect_to is null")
def live_nodes(v):
    return TB.live(rich(v)).select("slug")


@query(f"with {RICH} select slug, display_label, description, redirect_to from rich where slug = 'p7'")
def node_detail(v):
    return TB.get_node(rich(v), "concept", "p7").select("slug", "display_label", "description", "redirect_to")


@query(f"with {RICH} select slug, display_label || chr(10) || array_to_string(aliases, ', ') || chr(10) || 'd' as text from rich")
def node_texts(v):
    return rich(v).select("slug", SE.node_text(F.col("display_label"), F.col("aliases"), F.col("description"), F.col("note")).alias("text"))


@query(f"""with {RICH} select a.slug as slug_a, b.slug as slug_b, case when coalesce(a.created_at, '') <= coalesce(b.created_at, '') then a.slug else b.slug end as survivor
  from rich a join rich b on substr(b.slug, 2)::int = substr(a.slug, 2)::int + 1""")
def merge_survivor(v):
    n = rich(v).select("slug", "created_at", F.substring("slug", 2, 20).cast("int").alias("i"))
    b = n.select(F.col("slug").alias("slug_b"), F.col("created_at").alias("created_b"), (F.col("i") - 1).alias("i"))
    return n.withColumnRenamed("slug", "slug_a").join(b, "i").select("slug_a", "slug_b", R.survivor_of(F.col("created_at"), F.col("created_b"), F.col("slug_a"), F.col("slug_b")).alias("survivor"))


@query(f"""{BASE}, dr as (select paper_slug, from_type, from_slug as from_id, to_type, to_slug as to_id, rel_type as type, rationale from relations_raw),
  ids as (select distinct paper_slug, from_type as node_type, from_slug as id, 'n-' || from_slug as slug from relations_raw union select distinct paper_slug, to_type, to_slug, 'n-' || to_slug from relations_raw where to_slug not like '%7'),
  j as (select f.slug as from_slug, t.slug as to_slug, dr.*, type in (select rel_type from relation_types where "symmetric") and (from_type > to_type or (from_type = to_type and f.slug > t.slug)) as swap from dr
    join ids f on f.paper_slug = dr.paper_slug and f.node_type = dr.from_type and f.id = dr.from_id join ids t on t.paper_slug = dr.paper_slug and t.node_type = dr.to_type and t.id = dr.to_id where type <> 'SOLVES')
  select case when swap then to_type else from_type end as from_type, case when swap then to_slug else from_slug end as from_slug, type as rel_type, case when swap then from_type else to_type end as to_type,
    case when swap then from_slug else to_slug end as to_slug, rationale, paper_slug from j""")
def ingest_relations(v):
    r = v.relations_raw
    drawn = r.select("paper_slug", "from_type", F.col("from_slug").alias("from_id"), "to_type", F.col("to_slug").alias("to_id"), F.col("rel_type").alias("type"), "rationale")
    end = lambda d, s: d.select("paper_slug", F.col(f"{s}_type").alias("node_type"), F.col(f"{s}_slug").alias("id"), F.concat(F.lit("n-"), f"{s}_slug").alias("slug"))
    ids = end(r, "from").union(end(r.filter("to_slug not like '%7'"), "to")).distinct()
    return ST.ingest_relations(drawn, ids, v.relation_types.filter("rel_type <> 'SOLVES'"))


@query(f"{BASE} select * from relations_raw where not (rel_type = 'USES' and from_type = 'entity')")
def remove_relation(v):
    return ST.remove_relation(v.relations_raw, v.relations_raw.filter("rel_type = 'USES' and from_type = 'entity'"))


@query(f"{BASE} select * from relations_raw where from_type = 'entity' and from_slug = 's1'")
def node_relations(v):
    return TB.relations_of(v.relations_raw, "entity", "s1")


@query("select 'concept' as type, 'p' || p_partkey as slug_a, case when p_partkey % 4 < 2 then 'pending' end as status from part where p_partkey % 4 < 3 and p_partkey % 4 <> 2 or p_partkey % 4 = 2")
def pending_candidates(v):
    p = F.col("p_partkey")
    queue = v.part.select(F.lit("concept").alias("type"), F.concat(F.lit("p"), p).alias("slug_a"), F.when(p % 4 < 2, "pending").when(p % 4 == 3, "rejected").alias("status"))
    return TB.candidates(queue)


@query(f"""{NODES}, tg as (select 'o' || o_orderkey as name from orders union all select upper(n_name) from nation union all select replace(p_name, ' ', '_') || ' ' || p_partkey from part union all select 'nothing like it'),
  c as (select {NORM.format('display_label')} as key, min(slug) as slug from concepts group by 1), e as (select {NORM.format('display_label')} as key, min(slug) as slug from entities group by 1)
  select distinct name, case when p.slug is not null then 'note' when c.slug is not null then 'concept' else 'entity' end as type, coalesce(p.slug, c.slug, e.slug) as slug
  from (select distinct name from tg) t left join papers p on p.slug = t.name left join c on c.key = {NORM.format('t.name')} left join e on e.key = {NORM.format('t.name')} where coalesce(p.slug, c.slug, e.slug) is not null""")
def resolve_links(v):
    t = v.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("name")).union(v.nation.select(F.upper("n_name"))).union(v.part.select(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(" "), "p_partkey"))).union(v.spark.sql("select 'nothing like it'"))
    return R.resolve_links(t, v.papers, v.concepts, v.entities)


ORACLE_SQL["resolve_links"] = ORACLE_SQL["resolve_links"].replace("replace(p_name, ' ', '_')", "replace(p_name, ' ', '-')")


@query(f"{BASE} select folder_id, paper_slug, slug as pos, title from folder_papers join papers on slug = paper_slug")
def folder_members(v):
    return SC.folder_members(v.folder_papers.withColumn("pos", F.col("paper_slug")), v.papers).select("folder_id", "paper_slug", "pos", "title")


@query(f"{BASE} select id, name, case when id = 'f4' then 'b2' else brain_id end as brain_id from folders")
def set_folder_brain(v):
    return SC.set_folder_brain(v.folders, "f4", "b2").select("id", "name", "brain_id")


@query(f"{BASE} select 'folder' as kind, id as item from folders where id <> 'f3' union all select 'paper', paper_slug from folder_papers where folder_id <> 'f3'")
def delete_folder(v):
    f, m = SC.delete_folder(v.folders, v.folder_papers, "f3")
    return f.select(F.lit("folder").alias("kind"), F.col("id").alias("item")).unionByName(m.select(F.lit("paper").alias("kind"), F.col("paper_slug").alias("item")))


@query(f"{BASE} select id, name, brain_id from folders union all select 'f99', 'Fresh', null")
def create_folder(v):
    return SC.create(v.folders, "f99", " Fresh ", "2024-01-01").select("id", "name", "brain_id")


@query(f"{BASE} select id, case when id = 'b2' then 'Renamed' else name end as name from brains")
def rename_brain(v):
    return SC.rename(v.brains, "b2", "Renamed ").select("id", "name")


@query(f"{BASE} select folder_id, paper_slug from folder_papers where paper_slug <> 'o1'")
def remove_paper_from_folders(v):
    return SC.move_paper(v.folder_papers, "o1", None)


@query()
def resolve_batch(v):
    """Names of parts arrive in order; each one meets the nodes made before it."""
    p = v.part.select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("label"), F.array().cast("array<string>").alias("aliases"), F.concat(F.lit("o"), "p_partkey").alias("paper_slug"), F.lit(None).cast("string").alias("paper_title"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("at"))
    nodes, _ = R.resolve_batch(v.spark, p, "concept")
    return nodes.select("slug", "display_label", F.array_join("aliases", "|").alias("aliases"), F.size("papers").cast("long").alias("n_papers"))


def extractions(v: Views, concept_line: int = 1, entity_line: int = 2) -> DataFrame:
    """What a reader could have drawn from each order: a part as a concept, a supplier as an entity of it, and a relation."""
    line = lambda n, c, name: v.lineitem.filter(F.col("l_linenumber") == n).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(c).alias(name))
    d = v.orders.join(line(concept_line, "l_partkey", "p_partkey"), "o_orderkey").join(line(entity_line, "l_suppkey", "s_suppkey"), "o_orderkey").join(v.part.select("p_partkey", "p_name"), "p_partkey").join(v.supplier.select("s_suppkey", "s_name"), "s_suppkey")
    none = F.lit(None).cast("array<string>")
    return d.select(
        F.concat(F.lit("o"), "o_orderkey").alias("paper_slug"), F.concat(F.lit("Order "), "o_orderkey").alias("title"),
        F.array(F.struct(F.lit("c1").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.upper(F.concat("p_name", F.lit(" "), "p_partkey"))).otherwise(F.concat("p_name", F.lit("-"), "p_partkey")).alias("label"), none.alias("aliases"))).alias("concepts"),
        F.array(F.struct(F.lit("e1").alias("id"), F.col("s_name").alias("label"), F.lit("c1").alias("concept_id"), none.alias("aliases"))).alias("entities"),
        F.array(F.struct(F.lit("e1").alias("from_id"), F.lit("entity").alias("from_type"), F.lit("c1").alias("to_id"), F.lit("concept").alias("to_type"), F.when(F.col("o_orderkey") % 3 == 0, "USES").otherwise("COMPARED_TO").alias("type"), F.concat(F.lit("because "), "o_orderkey").alias("rationale"))).alias("relationships"),
    )


def versions_of(v: Views, run: str):
    from .sources import versions

    return versions.opened(v.spark, f"{run}/store")


def sent(papers: DataFrame, inbox: str, files: int) -> None:
    papers.select(F.to_json(F.struct("*")).alias("value")).repartition(files).write.mode("append").text(inbox)


@query(f"""with d as (select 'o' || o_orderkey as paper, o_orderkey, replace({NORM.format("p_name || ' ' || p_partkey")}, ' ', '-') as c, replace({NORM.format('s_name')}, ' ', '-') as e from orders
    join (select l_orderkey, min(l_partkey) as l_partkey from lineitem where l_linenumber = 1 group by 1) l1 on l1.l_orderkey = o_orderkey
    join (select l_orderkey, min(l_suppkey) as l_suppkey from lineitem where l_linenumber = 2 group by 1) l2 on l2.l_orderkey = o_orderkey join part on p_partkey = l1.l_partkey join supplier on s_suppkey = l2.l_suppkey),
  m as (select 'concept' as node_type, c as node_slug, paper, null as concept_slug from d union select 'entity', e, paper, c from d),
  r as (select distinct c, e, case when o_orderkey % 3 = 0 then 'USES' else 'COMPARED_TO' end as t from d),
  k as (select 'concept' as node_type, c as node_slug, count(*) as n from r group by c union all select 'entity', e, count(*) from r group by e)
  select m.node_type, m.node_slug, count(distinct paper)::bigint as n_papers, count(distinct concept_slug)::bigint as n_concepts, max(k.n)::bigint as n_relations from m join k using (node_type, node_slug) group by m.node_type, m.node_slug""")
def stream_ingest(v):
    """A paper for each order, streamed in two batches of files and resolved against the store as it grows."""
    from .sources import versions
    from .streaming import ingest

    run = scratch(v.spark, "stream")
    sent(extractions(v), f"{run}/inbox", 4)
    ingest.start(v.spark, f"{run}/inbox", f"{run}/store", f"{run}/state", files_per_batch=2, buckets=16).awaitTermination()
    after = {t: versions.opened(v.spark, f"{run}/store").table(t) for t in ("nodes", "mentions", "relations")}
    r = after["relations"]
    ends = r.select(F.col("from_type").alias("node_type"), F.col("from_slug").alias("node_slug")).unionAll(r.select("to_type", "to_slug")).groupBy("node_type", "node_slug").agg(F.count("*").alias("n_relations"))
    m = after["mentions"].groupBy("node_type", "node_slug").agg(F.count_distinct("paper_slug").alias("n_papers"), F.count_distinct("concept_slug").alias("n_concepts"))
    nodes = after["nodes"].select("node_type", F.col("slug").alias("node_slug"))
    return nodes.join(m, ["node_type", "node_slug"]).join(ends, ["node_type", "node_slug"])


LINE = "(select l_orderkey, min(l_partkey) as p, min(l_suppkey) as s from lineitem where l_linenumber = {0} group by 1) l{0} on l{0}.l_orderkey = o_orderkey"
DRAWN = f"""select 'o' || o_orderkey as paper, o_orderkey, replace({NORM.format("p_name || ' ' || p_partkey")}, ' ', '-') as c, replace({NORM.format('s_name')}, ' ', '-') as e from orders
  join {LINE.format(1)} join {LINE.format(2)}"""


@query(f"""with a as ({DRAWN} join part on p_partkey = l1.p join supplier on s_suppkey = l2.s),
  z as ({DRAWN} join part on p_partkey = l2.p join supplier on s_suppkey = l1.s where o_orderkey % 10 = 0),
  d as (select * from z union all select * from a anti join z using (paper)),
  m as (select 'concept' as node_type, c as node_slug, paper, null as concept_slug from d union select 'entity', e, paper, c from d),
  r as (select distinct c, e, case when o_orderkey % 3 = 0 then 'USES' else 'COMPARED_TO' end as t, paper from (select * from a union all select * from z)),
  manual as (select replace({NORM.format('s_name')}, ' ', '-') as e from supplier),
  k as (select 'concept' as node_type, c as node_slug, count(distinct (e, t)) as n, count(distinct (e, t, paper)) as p from r group by c
    union all select 'entity', e, count(distinct (c, t)) filter (c is not null) + count(*) filter (c is null), count(distinct (c, t, paper)) filter (c is not null)
      from (select e, c, t, paper from r union all select e, null, null, null from manual) group by e)
  select m.node_type, m.node_slug, count(distinct paper)::bigint as n_papers, count(distinct concept_slug)::bigint as n_concepts, max(k.n)::bigint as n_relations, max(k.p)::bigint as n_relation_papers
  from m join k using (node_type, node_slug) group by m.node_type, m.node_slug""")
def stream_replace(v):
    """A store with relations drawn by hand, then a paper for each order, then a tenth of the papers again with other contents: old mentions go, nodes that nothing mentions go, relations stay."""
    from .operators import ingest as IN
    from .sources import versions
    from .streaming import ingest

    run = scratch(v.spark, "stream")
    by_hand = v.supplier.select(F.lit("entity").alias("from_type"), R.slug_of(F.col("s_name")).alias("from_slug"), F.lit("PART_OF").alias("rel_type"), F.lit("entity").alias("to_type"), F.lit("the-market").alias("to_slug"), F.lit("").alias("rationale"), F.array().cast("array<string>").alias("sources"))
    versions.created(v.spark, f"{run}/store", {**IN.empty(v.spark), "relations": by_hand}, buckets=16)
    for papers in (extractions(v), extractions(v, 2, 1).filter("cast(substr(paper_slug, 2) as bigint) % 10 = 0")):
        sent(papers, f"{run}/inbox", 1)
        ingest.start(v.spark, f"{run}/inbox", f"{run}/store", f"{run}/state").awaitTermination()
    after = {t: versions.opened(v.spark, f"{run}/store").table(t) for t in ("nodes", "mentions", "relations")}
    r = after["relations"].withColumn("n", F.size("sources"))
    ends = r.select(F.col("from_type").alias("node_type"), F.col("from_slug").alias("node_slug"), "n").unionAll(r.select("to_type", "to_slug", "n")).groupBy("node_type", "node_slug")
    ends = ends.agg(F.count("*").alias("n_relations"), F.sum("n").alias("n_relation_papers"))
    m = after["mentions"].groupBy("node_type", "node_slug").agg(F.count_distinct("paper_slug").alias("n_papers"), F.count_distinct("concept_slug").alias("n_concepts"))
    nodes = after["nodes"].select("node_type", F.col("slug").alias("node_slug"))
    return nodes.join(m, ["node_type", "node_slug"], "left").join(ends, ["node_type", "node_slug"], "left").fillna(0)


NUMBER = "substr({0}, 2)::bigint"


@query(f"""{PB}, hm as (select slug, case when {NUMBER.format('slug')} % 22 = 0 then null when {NUMBER.format('slug')} % 7 = 0 then 'b' || ((custkey + 1) % 5) else brain_id end as brain_id
    from papers join pb on paper_slug = slug where {NUMBER.format('slug')} % 11 <> 0 or {NUMBER.format('slug')} % 22 = 0),
  lv as (select * from nodes where node_type = 'entity' or {NUMBER.format('slug')} % 13 <> 0),
  ti as (select * from mentions where node_type = 'entity' or {NUMBER.format('paper_slug')} % 5 <> 1 union all select 'concept', 'p' || l_partkey, 'o' || l_orderkey, null from lineitem where l_linenumber = 3 and l_orderkey % 5 = 1),
  j as (select t.*, c.slug as live_concept, p.slug as paper, p.brain_id from ti t join lv n on n.node_type = t.node_type and n.slug = t.node_slug
    left join lv c on c.node_type = 'concept' and c.slug = t.concept_slug and t.node_type = 'entity' left join hm p on p.slug = t.paper_slug)
  select 'edge' as kept, case when live_concept is not null then 'concept:' || live_concept else 'paper:' || paper end as a, node_type || ':' || node_slug as b, count(*)::bigint as n from j
    where live_concept is not null or paper is not null group by all
  union all select 'tag', node_type || ':' || node_slug, brain_id, count(*) from j where brain_id is not null group by all
  union all select 'semantic', from_type || ':' || from_slug, rel_type || ' ' || to_type || ':' || to_slug, count(*) from relations_raw r semi join lv f on f.node_type = from_type and f.slug = from_slug
    semi join lv t on t.node_type = to_type and t.slug = to_slug where rel_type <> 'USES' group by all""")
def stream_mirror(v):
    """A kept mirror of all nodes, papers, mentions and relations; papers move to other brains, go and come back, concepts die, mentions and relations go and come, in two streamed batches."""
    from .operators import mirror as MI
    from .streaming import mirror

    run = scratch(v.spark, "mirror")
    mirror.created(v.spark, f"{run}/store", MI.whole(v.nodes, brains_of(v), v.mentions, v.relations_raw), 16)
    o, paper = F.col("o_orderkey"), F.concat(F.lit("o"), "o_orderkey").alias("paper_slug")
    is_paper, at = F.lit("paper").alias("kind"), lambda seq: F.lit(seq).alias("seq")
    moves = v.orders.filter(o % 7 == 0).select(at(1), is_paper, paper, F.lit(True).alias("there"), F.concat(F.lit("b"), (F.col("o_custkey") + 1) % 5).alias("brain_id"))
    gone = v.orders.filter(o % 11 == 0).select(at(2), is_paper, paper, F.lit(False).alias("there"))
    back = v.orders.filter(o % 22 == 0).select(at(3), is_paper, paper, F.lit(True).alias("there"))
    dead = v.part.filter("p_partkey % 13 = 0").select(at(3), F.lit("node").alias("kind"), F.lit("concept").alias("node_type"), F.concat(F.lit("p"), "p_partkey").alias("node_slug"), F.lit(False).alias("there"))
    line = lambda number, n: v.lineitem.filter((F.col("l_linenumber") == number) & (F.col("l_orderkey") % 5 == 1)).select(
        at(3), F.lit("mention").alias("kind"), F.lit("concept").alias("node_type"), F.concat(F.lit("p"), "l_partkey").alias("node_slug"), F.concat(F.lit("o"), "l_orderkey").alias("paper_slug"), F.lit(n).alias("n"))
    unrelated = v.relations_raw.filter("rel_type = 'USES'").select(at(3), F.lit("relation").alias("kind"), F.col("from_type").alias("node_type"), F.col("from_slug").alias("node_slug"), "rel_type", "to_type", "to_slug", F.lit(-1).alias("n"))
    for batch in ([moves, gone], [back, dead, line(1, -1), line(3, 1), unrelated]):
        rows = batch[0]
        for more in batch[1:]:
            rows = rows.unionByName(more, allowMissingColumns=True)
        sent(rows, f"{run}/inbox", 2)
        mirror.start(v.spark, f"{run}/inbox", f"{run}/store", f"{run}/state").awaitTermination()
    after = versions_of(v, run)
    side = lambda a, b: F.concat_ws(":", a, b)
    shown = lambda kept, a, b: after.table(kept).select(F.lit(kept.rstrip("s")).alias("kept"), a.alias("a"), b.alias("b"), "n")
    edges = shown("edges", side("src_type", "src_slug"), side("dst_type", "dst_slug"))
    return edges.unionByName(shown("tags", side("node_type", "node_slug"), F.col("brain_id"))).unionByName(shown("semantic", side("from_type", "from_slug"), F.concat("rel_type", F.lit(" "), side("to_type", "to_slug"))))


@query("""with recursive ch as (select o_orderkey as a, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as b from orders),
  fst as (select o_custkey as c, min(o_orderkey) as o from orders group by 1),
  ed as (select a, b from ch where b is not null and a % 5 <> 0 union select least(x.o, y.o), greatest(x.o, y.o) from fst x join fst y on y.c = x.c - x.c % 4 and x.c % 4 <> 0),
  sym as materialized (select a, b from ed union select b, a from ed),
  reach(v, x) as (select o_orderkey, o_orderkey from orders union select reach.v, sym.b from reach join sym on sym.a = reach.x)
  select v, min(x) as comp from reach group by v""")
def components_updated(v):
    """Orders tied to the next one of their customer; a fifth of the ties go, then first orders of neighbouring customers are tied: kept components instead of new ones."""
    from pyspark.sql.window import Window

    chain = v.orders.select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("b")).filter("b is not null")
    first = v.orders.groupBy(F.col("o_custkey").alias("c")).agg(F.min("o_orderkey").alias("a"))
    other = first.filter("c % 4 = 0").select(F.col("c").alias("d"), F.col("a").alias("b"))
    added = first.filter("c % 4 <> 0").join(other, F.col("d") == F.col("c") - F.col("c") % 4).select("a", "b")
    kept = C.components(chain, v.orders.select(F.col("o_orderkey").alias("v")))
    return C.updated(kept, chain, added, chain.filter("a % 5 = 0"))[0]


# ---- indexes for search ----
ASKERS = "asker as (select vec_id::varchar as qid, embedding::double[] as q from embeddings where vec_id % 50 = 0)"


def vector_index(v: Views):
    """All vectors but a tenth indexed at once, that tenth inserted afterwards."""
    from .operators import vector_index as VI

    rows, late = vectors(v), F.substring("node_slug", 2, 30).cast("long") % 10 == 3
    index = VI.built(rows.filter(~late), scratch(v.spark, "vectors"), cells=32)
    index.insert(rows.filter(late))
    return index


def askers(v: Views) -> DataFrame:
    return v.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("qid"), F.col("embedding").alias("q"))


@query(f"""with {VEC}, {ASKERS}, s as (select qid, node_type, node_slug, round(list_cosine_similarity(e, asker.q), 6) as score from vec, asker),
  t as (select * from s qualify row_number() over (partition by qid, node_type order by score desc, node_slug) <= 10)
  select *, row_number() over (partition by qid order by score desc, node_type, node_slug) as rank from t""")
def vector_index_exact(v):
    """The nearest rows of many queries by the index's exact way."""
    from .operators import vector_index as VI

    return VI.search(vector_index(v), askers(v), exact=True)


@query("select count(*) filter (vec_id % 50 = 0)::bigint as n_queries, true as recall_holds, true as reads_less from embeddings")
def vector_index_recall(v):
    """Whether the number of cells that some queries ask for finds nine tenths of the nearest of others, and reads fewer than all rows."""
    from .operators import vector_index as VI

    index, asked = vector_index(v), askers(v)
    probes = VI.probes_for(index, v.embeddings.filter("vec_id % 50 = 1").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")))
    some = VI.search(index, asked, probes=probes).select("qid", "node_type", "node_slug", F.lit(1).alias("hit"))
    both = VI.search(index, asked, exact=True).join(some, ["qid", "node_type", "node_slug"], "left")
    share = VI.share_read(index, asked, probes)
    found = both.agg(F.count_distinct("qid").alias("n_queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_holds"))
    return found.withColumn("reads_less", F.lit(share < 1))


@query(f"with {DOCS}, {BM} select * from bh where rank <= 10")
def fulltext_index(v):
    """BM25 by the index, whose last third came as a segment of its own."""
    from .operators import text_index as TI

    docs = documents(v)
    index = TI.built(docs.filter("id % 3 <> 2"), scratch(v.spark, "postings"), span=64).insert(docs.filter("id % 3 = 2"))
    return TI.search(index, ASK)


@query(f"with {DOCS}, {BM} select * from bh where rank <= 10")
def fulltext_index_merged(v):
    """The same after three segments were merged to one."""
    from .operators import text_index as TI

    docs = documents(v)
    index = TI.built(docs.filter("id % 3 = 0"), scratch(v.spark, "postings"), span=64)
    for i in (1, 2):
        index = index.insert(docs.filter(F.col("id") % 3 == i))
    return TI.search(index.merged(), ASK)


@query(f"""{GRAPH_NODES}, asked as (select 'p' || p_partkey as qid, lower(trim(substr(p_name, 3, 5))) as text from part where p_partkey % 50 = 0
    union all select 'q' || p_partkey, lower(trim(substr(p_name, 2, 2))) from part where p_partkey % 250 = 0 union all select 'n' || n_nationkey, lower(trim(n_name)) from nation
    union all select 'o' || o_orderkey, o_orderkey::varchar from orders where o_orderkey % 50 = 0)
  select qid, id, label, type, row_number() over (partition by qid order by label, id) as place from asked join gn on contains(lower(label), text) where type <> 'tag'
  qualify row_number() over (partition by qid order by label, id) <= 12""")
def label_index_search(v):
    """The search box for many texts by the index of trigrams, a part of whose labels came as a second segment; tags are hidden."""
    from .operators import label_index as LI

    nodes = all_nodes(v).select("id", "label", "type")
    late = F.col("type") == "entity"
    index = LI.built(nodes.filter(~late), scratch(v.spark, "labels"), 16).insert(nodes.filter(late))
    text = lambda rows, letter, key, text: rows.select(F.concat(F.lit(letter), key).alias("qid"), text.alias("text"))
    asked = text(v.part.filter("p_partkey % 50 = 0"), "p", "p_partkey", F.substring("p_name", 3, 5)).unionAll(text(v.part.filter("p_partkey % 250 = 0"), "q", "p_partkey", F.substring("p_name", 2, 2)))
    asked = asked.unionAll(text(v.nation, "n", "n_nationkey", F.col("n_name"))).unionAll(text(v.orders.filter("o_orderkey % 50 = 0"), "o", "o_orderkey", F.col("o_orderkey").cast("string")))
    return LI.search(index, asked, ("tag",)).withColumn("place", F.col("place").cast("long"))
