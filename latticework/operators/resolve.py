"""Entity resolution: label matching with exact-recall blocking, canonical labels, name lookups, merges, and the ordered resolver."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import minhash as M
from ..functions.text import label_key, label_slug, normalize_label
from .components import components, cut


def signed(labels: DataFrame, column: str = "label") -> DataFrame:
    """Distinct keys of the labels with their signatures: (key, sig). Each key is hashed once."""
    return labels.select(normalize_label(F.col(column)).alias("key")).distinct().withColumn("sig", M.signature(F.col("key")))


def blocked(keys: DataFrame, name: str) -> DataFrame:
    """(block, name): a row for each key and block, without the signatures, which would go with every block."""
    return keys.select(F.explode(M.band_keys(F.col("key"), F.col("sig"))).alias("block"), F.col("key").alias(name))


def alike(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b) those that match; ``a`` and ``b``: key, sig."""
    side = lambda keys, name: keys.select(F.col("key").alias(name), F.col("sig").alias(f"sig_{name}")).hint("merge")
    both = pairs.join(side(a, "a"), "a").join(side(b, "b"), "b")
    return both.filter(M.keys_match(F.col("a"), F.col("b"), F.col("sig_a"), F.col("sig_b"))).select("a", "b")


def match_pairs(keys: DataFrame) -> DataFrame:
    """``keys``: key, sig. All pairs of different keys that match (a < b), found by blocking that misses none."""
    k = cut(keys)
    # blocks are many times what Spark takes them for, since it doesn't see how long signatures and arrays are; so none is broadcast
    near = blocked(k, "a").join(blocked(k, "b").hint("merge"), "block").filter("a < b").select("a", "b").distinct()
    return alike(near, k, k)


def match_two_sides(probes: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (probe key, name key) that match; both sides have key, sig."""
    near = blocked(probes, "a").join(blocked(names, "b").hint("merge"), "block").select("a", "b").distinct()
    return alike(near, probes, names).select(F.col("a").alias("p"), F.col("b").alias("n"))


def alias_pairs(labels: DataFrame) -> DataFrame:
    """``labels``: label, aliases. Key pairs that share an alias, or of which one is an alias of the other."""
    rows = labels.select(normalize_label(F.col("label")).alias("key"), F.explode_outer("aliases").alias("alias"))
    rows = rows.filter("alias is not null").select("key", normalize_label(F.col("alias")).alias("alias")).filter("alias <> ''").distinct()
    # a hub for each alias instead of pairs: every holder is tied to the least holder
    least = rows.groupBy("alias").agg(F.min("key").alias("a"))
    shared = rows.join(least, "alias").filter("a <> key").select("a", F.col("key").alias("b"))
    keys = labels.select(normalize_label(F.col("label")).alias("alias")).distinct()
    claimed = rows.join(keys, "alias", "left_semi").filter("alias <> key").select(F.col("alias").alias("a"), F.col("key").alias("b"))
    return shared.union(claimed).distinct()


def canonical_labels(labels: DataFrame) -> DataFrame:
    """``labels``: label[, aliases]. (label, canonical): the shortest label of its component, the first of several."""
    given = labels.select("label").distinct().withColumn("key", normalize_label(F.col("label")))
    edges = match_pairs(signed(labels))
    if "aliases" in labels.columns:
        edges = edges.union(alias_pairs(labels))
    comp = components(edges, given.select(F.col("key").alias("v")))
    tied = given.join(comp.withColumnRenamed("v", "key"), "key")
    best = tied.groupBy("comp").agg(F.min(F.struct(F.length("label").alias("n"), "label")).alias("m"))
    return tied.join(best, "comp").select("label", F.col("m.label").alias("canonical"))


def names(nodes: DataFrame) -> DataFrame:
    """``nodes``: slug, display_label[, aliases]. (key, slug, ord): names of each node, its label first."""
    listed = F.array(F.col("display_label"))
    if "aliases" in nodes.columns:
        listed = F.concat(listed, F.coalesce("aliases", F.array().cast("array<string>")))
    return nodes.select("slug", F.posexplode(listed).alias("ord", "name")).withColumn("key", normalize_label(F.col("name"))).filter("key <> ''").select("key", "slug", "ord")


def name_index(nodes: DataFrame) -> DataFrame:
    """(key, slug): the first node by slug that goes by a name."""
    return names(nodes).groupBy("key").agg(F.min("slug").alias("slug"))


def exact_lookup(probes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``probes``: name. (name, slug) of those that a node goes by."""
    return probes.select("name", normalize_label(F.col("name")).alias("key")).join(name_index(nodes), "key").select("name", "slug")


def fuzzy_lookup(probes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, slug): exact match first; on a miss the first node by slug with a matching name; else null."""
    return looked_up(cut(probes.select("name", normalize_label(F.col("name")).alias("key")).distinct()), nodes)


def looked_up(p: DataFrame, nodes: DataFrame) -> DataFrame:
    """``fuzzy_lookup`` of names with their keys (name, key). Names may be many, so no side is broadcast, and only those are signed whose numbers some node has."""
    listed = cut(names(nodes).groupBy("key").agg(F.min("slug").alias("slug")))
    found = cut(p.join(listed.hint("merge"), "key", "left"))
    numbers = F.array_join(M.numeric_tokens(F.col("key")), ",").alias("numbers")
    missed = found.filter("slug is null").select("key", numbers).distinct().hint("merge").join(listed.select(numbers).distinct(), "numbers", "left_semi").select("key")
    met = listed.select("key", numbers).hint("merge").join(missed.select(numbers).distinct(), "numbers", "left_semi").select("key")
    signed_keys = lambda keys: cut(keys.withColumn("sig", M.signature(F.col("key"))))
    near = match_two_sides(signed_keys(cut(missed)), signed_keys(cut(met)))
    slugs = near.join(listed.withColumnRenamed("key", "n").hint("merge"), "n").groupBy(F.col("p").alias("key")).agg(F.min("slug").alias("near"))
    return found.join(slugs.hint("merge"), "key", "left").select("name", F.coalesce("slug", "near").alias("slug"))


def resolve_links(targets: DataFrame, notes: DataFrame, concepts: DataFrame, entities: DataFrame) -> DataFrame:
    """``targets``: name. (name, type, slug): a note of that slug, else a concept, else an entity; others are dropped."""
    p = cut(targets.select("name", normalize_label(F.col("name")).alias("key")).distinct())
    n = p.select("name").join(notes.select(F.col("slug").alias("name"), F.col("slug").alias("note")).hint("merge"), "name", "left")
    c = looked_up(p, concepts).withColumnRenamed("slug", "concept")
    e = looked_up(p, entities).withColumnRenamed("slug", "entity")
    j = n.join(c.hint("merge"), "name", "left").join(e.hint("merge"), "name", "left")
    kind = F.when(F.col("note").isNotNull(), "note").when(F.col("concept").isNotNull(), "concept").when(F.col("entity").isNotNull(), "entity")
    return j.select("name", kind.alias("type"), F.coalesce("note", "concept", "entity").alias("slug")).filter("type is not null")


def unordered(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))


def new_candidates(found: DataFrame, queue: DataFrame) -> DataFrame:
    """``found``: type, slug_a, slug_b, ... without pairs that the queue has in any status, in either order, and without repeats."""
    key = F.struct("type", unordered(F.col("slug_a"), F.col("slug_b")).alias("pair"))
    f = found.withColumn("__key", key).filter("slug_a <> slug_b").dropDuplicates(["__key"])
    return f.join(queue.select(key.alias("__key")).distinct(), "__key", "left_anti").drop("__key").withColumn("status", F.lit("pending"))


def decide(queue: DataFrame, type: str, slug_a: str, slug_b: str, status: str, at: str) -> DataFrame:
    """Set the status of a pair, with the time in ``rejected_at`` or ``merged_at``."""
    hit = (F.col("type") == type) & (unordered(F.col("slug_a"), F.col("slug_b")) == unordered(F.lit(slug_a), F.lit(slug_b)))
    stamp = f"{status}_at"
    return queue.withColumns({"status": F.when(hit, status).otherwise(F.col("status")), stamp: F.when(hit, F.lit(at)).otherwise(F.col(stamp))})


def merge_sources(mentions: DataFrame, merges: DataFrame) -> DataFrame:
    """``merges``: survivor, loser (slugs of one type; each in one merge). Mentions after the merges: the survivor's, then the loser's whose paper the survivor
    doesn't have. A missing paper equals a missing paper."""
    m = mentions.withColumn("ord", F.coalesce("ord", F.lit(0)))
    taken = m.join(merges.select(F.col("loser").alias("node_slug"), "survivor"), "node_slug")
    own = m.join(merges.select(F.col("survivor").alias("node_slug")), "node_slug", "left_semi").select(F.col("node_slug").alias("s"), F.col("paper_slug").alias("p"))
    fresh = taken.join(own, (taken["survivor"] == own["s"]) & taken["paper_slug"].eqNullSafe(own["p"]), "left_anti")
    last = m.join(merges.select(F.col("survivor").alias("node_slug")).distinct(), "node_slug", "left_semi").groupBy(F.col("node_slug").alias("survivor")).agg(F.max("ord").alias("__last"))
    moved = fresh.join(last, "survivor", "left").withColumn("ord", F.col("ord") + F.coalesce("__last", F.lit(-1)) + 1).withColumn("node_slug", F.col("survivor")).drop("survivor", "__last")
    return m.join(merges.select(F.col("loser").alias("node_slug")), "node_slug", "left_anti").unionByName(moved.select(*m.columns))


def merge_nodes(nodes: DataFrame, merges: DataFrame, merged_at: str) -> DataFrame:
    """Survivors get the aliases, label and notes of their losers; losers become redirects. Relations, categories and descriptions stay behind."""
    j = merges.join(nodes.alias("l"), F.col("loser") == F.col("l.slug")).select("survivor", F.col("l.slug").alias("l_slug"), F.col("l.display_label").alias("l_label"), F.col("l.aliases").alias("l_aliases"), F.col("l.merged_from").alias("l_from"), F.col("l.user_notes").alias("l_notes"))
    s = nodes.join(j.withColumnRenamed("survivor", "slug"), "slug", "left").join(merges.select(F.col("loser").alias("slug"), F.col("survivor").alias("to")), "slug", "left")
    none = F.array().cast("array<string>")
    both = F.array_sort(F.array_distinct(F.concat(F.coalesce("aliases", none), F.array("l_label"), F.coalesce("l_aliases", none))))
    hit = F.col("l_slug").isNotNull()
    notes = F.when(F.trim(F.coalesce("l_notes", F.lit(""))) != "", F.concat(F.coalesce("user_notes", F.lit("")), F.lit(f"\n\n--- merged {merged_at[:10]} ---\n\n"), "l_notes")).otherwise(F.col("user_notes"))
    return s.withColumns({
        "aliases": F.when(hit, both).otherwise(F.col("aliases")),
        "merged_from": F.when(hit, F.concat(F.coalesce("merged_from", none), F.array("l_slug"), F.coalesce("l_from", none))).otherwise(F.col("merged_from")),
        "user_notes": F.when(hit, notes).otherwise(F.col("user_notes")),
        "redirect_to": F.coalesce("to", "redirect_to"),
    }).select(*nodes.columns)


def survivor_of(created_a: Column, created_b: Column, a: Column, b: Column) -> Column:
    """The older one; a missing time is the oldest, and the first wins a tie."""
    return F.when(F.coalesce(created_a, F.lit("")) <= F.coalesce(created_b, F.lit("")), a).otherwise(b)


class Resolver:
    """Order-dependent resolution of names as they arrive: each one meets the nodes made before it.

    State is an index of names of one node type; arrivals are taken one by one, while the index is looked up by keys of the bands that match
    lookups in Spark use, and what a known key matches is kept. ``resolve_batch`` runs one for each component of names, on the workers.
    """

    def __init__(self, node_type: str):
        self.node_type = node_type
        self.nodes: dict[str, dict] = {}
        self.owners: dict[str, set[str]] = {}
        self.near: dict[str, list[str]] = {}
        self.blocks: dict[tuple, list[str]] = {}
        self.signatures: dict[str, list[int]] = {}

    @staticmethod
    def match(a: str, b: str, signatures: dict[str, list[int]]) -> bool:
        if a == b:
            return True
        if not a or not b or re.findall(r"\d+", a) != re.findall(r"\d+", b):
            return False
        short, long = sorted((a, b), key=len)
        if len(long) - len(short) <= 1 and long.startswith(short):
            return True
        for k in (a, b):
            if k not in signatures:
                signatures[k] = M.signature_rows([k])[0]
        return sum(x == y for x, y in zip(signatures[a], signatures[b], strict=True)) / M.PERMUTATIONS >= M.THRESHOLD

    def blocks_of(self, key: str) -> list[tuple]:
        if key not in self.signatures:
            self.signatures[key] = M.signature_rows([key])[0]
        return M.band_rows(key, self.signatures[key])

    def matches(self, key: str) -> list[str]:
        """Known keys that match."""
        if key in self.near:
            return self.near[key]
        some = dict.fromkeys(o for block in self.blocks_of(key) for o in self.blocks.get(block, ()))
        return [o for o in some if self.match(key, o, self.signatures)]

    def add(self, key: str, slug: str) -> None:
        if key not in self.near:
            found = self.matches(key)
            for o in found:
                self.near[o].append(key)
            self.near[key] = [key, *found]
            for block in self.blocks_of(key):
                self.blocks.setdefault(block, []).append(key)
        self.owners.setdefault(key, set()).add(slug)

    def know(self, slug: str, label: str, aliases: list[str], at: str | None, papers: list[str], **fields) -> None:
        """A node that was there before."""
        self.nodes[slug] = {"slug": slug, "display_label": label, "aliases": list(aliases), "sources": {p: {} for p in papers}, "created_at": at, **fields}
        for k in dict.fromkeys(label_key(x) for x in [label, *aliases]):
            self.add(k, slug)

    def resolve(self, label: str, aliases: list[str], paper: str | None, title: str | None, at: str, concept: str | None = None, **fields) -> tuple[str, list[dict]]:
        """The node for a name: the oldest match, else a new one; other matches are recorded as merge candidates."""
        keys = [k for k in dict.fromkeys(label_key(x) for x in [label, *aliases])]
        hits = [self.nodes[slug] for slug in sorted({slug for k in keys for o in self.matches(k) for slug in self.owners[o]})]
        source = {"paper_slug": paper, "paper_title": title, "concept_slug": concept}
        if not hits:
            slug = label_key(label).replace(" ", "-")
            if slug in self.nodes:  # of a node that has since been given another name
                slug = next(s for i in range(2, len(self.nodes) + 3) if (s := f"{slug}-{i}") not in self.nodes)
            self.nodes[slug] = {"slug": slug, "display_label": label, "aliases": list(aliases), "sources": {paper: source}, "created_at": at, **fields}
            for k in keys:
                self.add(k, slug)
            return slug, []
        first = min(hits, key=lambda n: (n["created_at"] or "", n["slug"]))
        extra = [label] if label_key(label) != label_key(first["display_label"]) else []
        first["aliases"] = sorted({*first["aliases"], *aliases, *extra})
        for k in keys:
            self.add(k, first["slug"])
        if paper in first["sources"]:
            first["sources"][paper]["concept_slug"] = concept
        else:
            first["sources"][paper] = source
        found = [{"type": self.node_type, "slug_a": first["slug"], "slug_b": n["slug"], "via_alias": label, "detected_in_paper": paper, "detected_at": at} for n in hits if n is not first]
        return first["slug"], found


TEXTS = "description string, note string, categories array<string>"
NODE = f"slug string, display_label string, aliases array<string>, created_at string, papers array<string>, {TEXTS}"
ASSIGNED = "arrival string, assigned string"
CANDIDATE = "type string, slug_a string, slug_b string, via_alias string, detected_in_paper string, detected_at string"
#: What tells rows of the resolver apart: their component, and the arrival that made a node.
WHERE = "node_type string, comp string, made string"
TYPES = ("concept", "entity")


def names_of(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


_ROWS = pa.schema([(c.split()[0], pa.list_(pa.string()) if "array" in c else pa.string()) for c in f"{NODE}, {CANDIDATE}, {ASSIGNED}, {WHERE}".split(", ")])


def resolve_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of known nodes and arrivals with node_type and comp, by comp, known ones first, and seq. Rows of nodes, candidates and assignments (arrival, assigned); only one component's nodes
    are held at a time."""
    r, queue, before, out, texts = Resolver(""), {}, None, [], names_of(TEXTS)

    def finished() -> list[dict]:
        nodes = [{**n, "papers": list(n["sources"])} for n in r.nodes.values()]
        return [{c: row.get(c) for c in _ROWS.names} | {"comp": before, "node_type": r.node_type} for row in [*nodes, *queue.values()]]

    for batch in batches:
        for row in batch.to_pylist():
            if row["comp"] != before or row["node_type"] != r.node_type:
                out += finished()
                r, queue, before = Resolver(row["node_type"]), {}, row["comp"]
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, _ROWS)
                    out = []
            fields = {c: row[c] for c in texts}
            if row["known"] is not None:
                r.know(row["known"], row["label"], row["aliases"] or [], row["at"], row["papers"] or [], **fields)
                continue
            slug, found = r.resolve(row["label"], row["aliases"] or [], row["paper_slug"], row["paper_title"], row["at"], made=str(row["seq"]), **fields)
            out.append({**dict.fromkeys(_ROWS.names), "arrival": str(row["seq"]), "assigned": slug, "comp": before, "node_type": r.node_type})
            for c in found:
                queue.setdefault(frozenset((c["slug_a"], c["slug_b"])), c)
    out += finished()
    if out:
        yield pa.RecordBatch.from_pylist(out, _ROWS)


def with_texts(rows: DataFrame) -> DataFrame:
    """``rows`` with null columns of ``TEXTS`` where it lacks them."""
    return rows.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in TEXTS.split(", ") if c.split()[0] not in rows.columns})


def free_slugs(made: DataFrame, taken: DataFrame) -> DataFrame:
    """``made``: node_type, comp, slug, created_at, made of new nodes; ``taken``: node_type, slug. New slugs of those whose slug another node has, (comp, slug, free): the first of slug-2, slug-3, ... that no
    node has, in order of creation. Of several new nodes with one slug the first keeps it, if it is free at all."""
    own = ["node_type", "slug"]
    nth = F.row_number().over(Window.partitionBy(*own).orderBy("created_at", "made", "comp"))
    ranked = made.withColumn("n", nth).join(taken.select(*own, F.lit(1).alias("old")).distinct(), own, "left")
    late = cut(ranked.withColumn("n", F.col("n") - 1 + F.coalesce("old", F.lit(0))).filter("n > 0").select(*own, "comp", "n"))
    parts = lambda i: F.regexp_extract("slug", r"^(.*)-(\d{1,9})$", i)
    numbered = taken.select(*own).unionByName(made.select(*own)).select("node_type", parts(1).alias("slug"), parts(2).try_cast("int").alias("number"))
    used = numbered.join(late.select(*own).distinct(), own).distinct()
    room = late.groupBy(*own).agg(F.max("n").alias("most")).join(used.groupBy(*own).agg(F.count("*").alias("used")), own, "left")
    room = room.select(*own, F.explode(F.sequence(F.lit(2), (1 + F.col("most") + F.coalesce("used", F.lit(0))).cast("int"))).alias("number")).join(used, [*own, "number"], "left_anti")
    room = room.withColumn("n", F.row_number().over(Window.partitionBy(*own).orderBy("number")))
    return late.join(room, [*own, "n"]).select("comp", "slug", F.concat_ws("-", "slug", F.col("number").cast("string")).alias("free"))


def found_pairs(come: DataFrame, known: DataFrame | None) -> DataFrame:
    """(a, b): keys that match, of arrivals (key) among each other and with names of known nodes, by the band join."""
    come = cut(come.withColumn("sig", M.signature(F.col("key"))))
    pairs = match_pairs(come)
    if known is not None:
        there = names(known).select("key").distinct().withColumn("sig", M.signature(F.col("key")))
        pairs = pairs.unionByName(match_two_sides(come, there).select(F.col("p").alias("a"), F.col("n").alias("b")))
    return cut(pairs)


def resolve_typed(arrivals: DataFrame, known: DataFrame | None = None, pairs: DataFrame | None = None, taken: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``arrivals``: node_type, seq (any type that sorts), label, aliases, paper_slug, paper_title, at, and the columns of ``TEXTS`` if there are any; ``known``: node_type, slug, display_label, aliases, created_at, papers
    (and texts) of the nodes there are. Nodes (known ones that nothing arrives at are left as they are), candidates, and the node of each arrival (arrival: seq as text, assigned); node_type in each.

    Arrivals whose names are in different components of the match graph (names of one arrival or node are tied) never meet, so each component is resolved by itself, in order, on the
    workers. Of the known nodes only those take part that a name which arrives matches. ``pairs`` (node_type, a, b) are the keys that match, of arrivals among each other and with known names, where an index has them; else
    they are found by the band join of all lookups. New slugs differ from all known ones and from ``taken`` (node_type, slug; of redirects, say)."""
    none, texts = F.lit(None), names_of(TEXTS)
    columns = ["node_type", "seq", "label", "aliases", "paper_slug", "paper_title", "at", "known", "papers", *texts]
    a = with_texts(arrivals).withColumns({"known": none.cast("string"), "papers": none.cast("array<string>")}).select(*columns)
    come = typed_keys(a)
    if pairs is None:
        one = lambda df, t: df.filter(F.col("node_type") == t)
        for t in TYPES:
            mine = found_pairs(one(come, t).select("key"), None if known is None else one(known, t)).withColumn("node_type", F.lit(t))
            pairs = mine if pairs is None else pairs.unionByName(mine)
    untouched = None
    if known is not None:
        near = pairs.select("node_type", F.explode(F.array("a", "b")).alias("key")).unionByName(come).distinct()
        listed = known.select("node_type", "slug", F.explode(F.concat(F.array("display_label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
        met = cut(listed.select("node_type", "slug", normalize_label(F.col("name")).alias("key")).join(near, ["node_type", "key"], "left_semi").select("node_type", "slug").distinct())
        untouched = known.join(met, ["node_type", "slug"], "left_anti")
        k = with_texts(known).join(met, ["node_type", "slug"], "left_semi").select("node_type", none.cast(arrivals.schema["seq"].dataType).alias("seq"), F.col("display_label").alias("label"), "aliases",
            none.cast("string").alias("paper_slug"), none.cast("string").alias("paper_title"), F.col("created_at").alias("at"), F.col("slug").alias("known"), "papers", *texts)
        a = a.unionByName(k)
    # a vertex is a type and a key
    vertex = lambda c: F.concat_ws("|", "node_type", c)
    a = a.withColumn("v", vertex(normalize_label(F.col("label"))))
    aliases = a.select("v", "node_type", F.explode("aliases").alias("alias")).select("v", vertex(normalize_label(F.col("alias"))).alias("w")).distinct()
    edges = pairs.select(vertex("a").alias("a"), vertex("b").alias("b")).union(aliases.filter("v <> w"))
    comps = components(edges, a.select("v").union(aliases.select("w")).distinct())
    rows = a.join(comps, "v", "left").drop("v").repartition("comp").sortWithinPartitions("comp", F.col("known").isNull(), "known", "seq")
    done = cut(rows.mapInArrow(resolve_sorted, f"{NODE}, {CANDIDATE}, {ASSIGNED}, {WHERE}"))
    made = done.filter("made is not null").select("node_type", "comp", "slug", "created_at", "made")
    slugs = made.limit(0).select("node_type", "slug")
    for more in (known, taken):
        slugs = slugs if more is None else slugs.unionByName(more.select("node_type", "slug"))
    free = cut(free_slugs(made, slugs))
    if not free.isEmpty():
        done = cut(with_free(done, free))
    nodes = done.filter("type is null and arrival is null").select("node_type", *names_of(NODE))
    if untouched is not None:
        nodes = nodes.unionByName(with_texts(untouched).select("node_type", *names_of(NODE)))
    return nodes, done.filter("type is not null").select(*names_of(CANDIDATE)), done.filter("arrival is not null").select("node_type", *names_of(ASSIGNED))


def resolve_all(arrivals: DataFrame, node_type: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``resolve_typed`` for one type, without its column."""
    t = F.lit(node_type)
    one = arrivals.withColumn("node_type", t)
    pairs = found_pairs(typed_keys(one).select("key"), known).withColumn("node_type", t)
    nodes, found, assigned = resolve_typed(one, None if known is None else known.withColumn("node_type", t), pairs)
    return nodes.drop("node_type"), found, assigned.drop("node_type")


def with_free(done: DataFrame, free: DataFrame) -> DataFrame:
    """Rows of the resolver with new slugs of a component in place of the taken ones; ``free`` has a row for each, which are few."""
    for column in ("slug", "slug_a", "slug_b", "assigned"):
        mine = free.select("comp", F.col("slug").alias(column), "free")
        done = done.join(mine, ["comp", column], "left").withColumn(column, F.coalesce("free", column)).drop("free")
    return done


def typed_keys(arrivals: DataFrame) -> DataFrame:
    """(node_type, key): all names of arrivals."""
    listed = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
    return arrivals.select("node_type", F.explode(listed).alias("name")).select("node_type", normalize_label(F.col("name")).alias("key")).filter("key <> ''").distinct()


def resolve_batch(spark: SparkSession, arrivals: DataFrame, node_type: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (columns of ``NODE``) and candidates of one batch without known nodes."""
    return resolve_all(arrivals, node_type)[:2]


def slug_of(label: Column) -> Column:
    return label_slug(normalize_label(label))


def numeric_blocked(keys: DataFrame) -> DataFrame:
    """How many pairs of keys (key) would be similar but for their numbers, by the text without digits: (stem, keys, pairs)."""
    k = keys.select("key", F.regexp_replace("key", r"\d+", "#").alias("stem"), F.array_join(M.numeric_tokens(F.col("key")), ",").alias("numbers"))
    by = k.groupBy("stem", "numbers").agg(F.count("*").alias("n")).groupBy("stem").agg(F.sum("n").alias("keys"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return by.select("stem", "keys", ((F.col("keys") * F.col("keys") - F.col("same")) / 2).cast("long").alias("pairs"))


def suffix_pairs(keys: DataFrame) -> DataFrame:
    """(short, long): keys that differ by one more character at the end and not by numbers. One equi-join."""
    long = keys.select(F.col("key").alias("long")).filter(F.length("long") > 1).withColumn("short", F.expr("substring(long, 1, length(long) - 1)"))
    return long.join(keys.select(F.col("key").alias("short")), "short").filter(M.numeric_tokens(F.col("short")) == M.numeric_tokens(F.col("long"))).select("short", "long")
