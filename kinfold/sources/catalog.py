"""Names bound to DataFrames: entities by key, relations by foreign key or link table, views by their predicates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Dictionary, Entity, FilteredEntity, MergedEntity, ModelError, Property, Relation


#: Rows, or what makes them when they are first read.
Rows = DataFrame | Callable[[], DataFrame]


@dataclass(frozen=True)
class Binding:
    """Where a relation's edges are: in a foreign key column of one side (`holder` is source or target), or in a link table."""

    holder: str = ""
    column: str = ""
    links: Rows | None = None


@dataclass(frozen=True)
class End:
    """A relation seen from one of its records."""

    relation: Relation
    forward: bool
    owner: str
    target: str

    @property
    def many(self) -> bool:
        return self.relation.to_many(self.forward)


class Catalog:
    """All declarations and what they are bound to. Queries read it; it holds no rows itself."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.entities: dict[str, Entity | FilteredEntity | MergedEntity] = {}
        self.frames: dict[str, tuple[Rows, str]] = {}
        self.relations: dict[str, Relation] = {}
        self.bindings: dict[str, Binding] = {}
        self.dictionaries: dict[str, Dictionary] = {}

    # declarations

    def entity(self, decl: Entity, df: Rows, key: str = "id") -> Catalog:
        """Bind an entity; its rows get a column `id` from `key`. Columns that are not declared stay readable, with their types."""
        self.entities[decl.name] = decl
        self.frames[decl.name] = (df, key)
        return self

    def frame(self, name: str) -> DataFrame:
        df, key = self.frames[name]
        if callable(df) or key != "id":
            df = df() if callable(df) else df
            df = df if key == "id" else df.withColumn("id", F.col(key))
            self.frames[name] = (df, "id")
        return df

    def view(self, decl: FilteredEntity | MergedEntity) -> Catalog:
        for name in (decl.base,) if isinstance(decl, FilteredEntity) else decl.inputs:
            if name != decl.name and name not in self.entities:
                raise ModelError(f"{decl.name}: unknown entity {name}")
        self.entities[decl.name] = decl
        try:
            self.order(decl.name)
            if isinstance(decl, MergedEntity):
                self._check_merge(decl)
        except ModelError:
            del self.entities[decl.name]
            raise
        return self

    def relation(self, decl: Relation, fk: tuple[str, str] | None = None, links: Rows | None = None) -> Catalog:
        """Bind a relation by fk=("source" or "target", column of that side) or by links (source, target, id?, properties)."""
        if decl.base:
            if decl.base not in self.relations:
                raise ModelError(f"{decl.name}: unknown relation {decl.base}")
            self.relations[decl.name] = decl
            return self
        if (fk is None) == (links is None):
            raise ModelError(f"{decl.name}: give a foreign key or links")
        self.relations[decl.name] = decl
        self.bindings[decl.name] = Binding(*fk) if fk else Binding(links=links)
        return self

    def merged_relation(self, decl: Relation, inputs: list[str]) -> Catalog:
        """A union of relations with the same ends and cardinality; its links carry `__type`."""
        first = self.relations[inputs[0]]
        for name in inputs:
            r = self.relations[name]
            if (r.source, r.target, r.type) != (first.source, first.target, first.type):
                raise ModelError(f"{decl.name}: {name} differs in its ends or cardinality")
        part = lambda n: self.links(self.relations[n]).withColumn("__type", F.lit(n))
        return self.relation(decl, links=lambda: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(part, inputs)))

    def dictionary(self, decl: Dictionary) -> Catalog:
        self.dictionaries[decl.name] = decl
        return self

    # lookups

    def order(self, name: str) -> list[str]:
        """The names that a view is made of, inputs first; a cycle is an error."""
        out: list[str] = []

        def visit(n: str, above: tuple[str, ...]) -> None:
            if n in above:
                raise ModelError(f"views go in a circle: {' > '.join([*above, n])}")
            if n in out:
                return
            d = self.entities.get(n)
            if d is None:
                raise ModelError(f"unknown entity {n}")
            for m in (d.base,) if isinstance(d, FilteredEntity) else d.inputs if isinstance(d, MergedEntity) else ():
                visit(m, (*above, n))
            out.append(n)

        visit(name, ())
        return out

    def base_of(self, name: str) -> str:
        d = self.entities.get(name)
        if d is None:
            raise ModelError(f"unknown entity {name}")
        return self.base_of(d.base) if isinstance(d, FilteredEntity) else name

    def properties(self, name: str) -> dict[str, Property]:
        d = self.entities[self.base_of(name)]
        if isinstance(d, MergedEntity):
            out: dict[str, Property] = {}
            for n in d.inputs:
                out |= self.properties(n)
            return out
        return {p.name: p for p in d.properties}

    def property(self, name: str, prop: str) -> Property | None:
        return self.properties(name).get(prop)

    def end(self, entity: str, prop: str) -> End | None:
        """The relation that a property of an entity stands for."""
        base = self.base_of(entity)
        names = {entity, base, *([*self.entities[base].inputs] if isinstance(self.entities[base], MergedEntity) else ())}
        for r in self.relations.values():
            if r.source_property == prop and (r.source in names or self.base_of(r.source) == base):
                return End(r, True, r.source, r.target)
            if r.target_property == prop and prop and (r.target in names or self.base_of(r.target) == base):
                return End(r, False, r.target, r.source)
        return None

    def _check_merge(self, decl: MergedEntity) -> None:
        seen: dict[str, Property] = {}
        for n in decl.inputs:
            for p in self.properties(n).values():
                q = seen.setdefault(p.name, p)
                if (q.type, q.collection) != (p.type, p.collection):
                    raise ModelError(f"{decl.name}: {p.name} has different types in its inputs")
            if missing := set(decl.common) - set(self.properties(n)):
                raise ModelError(f"{decl.name}: {n} lacks {sorted(missing)}")

    # rows

    def scan(self, name: str) -> DataFrame:
        """The rows of an entity or view, with `id`. Rows without an id are not records."""
        from ..plans.compiler import restrict

        d = self.entities.get(name)
        if d is None:
            raise ModelError(f"unknown entity {name}")
        if isinstance(d, FilteredEntity):
            from ..plans.match import Match

            return restrict(self, d.base, self.scan(d.base), Match.of(d.match))
        if isinstance(d, MergedEntity):
            parts = []
            for n in d.inputs:
                part = self.scan(n)
                keep = ["id", *[c for c in self.properties(n) if c in part.columns and c != "id"], *(["__type"] if "__type" in part.columns else [])]
                part = part.select(*keep)
                parts.append(part if "__type" in part.columns else part.withColumn("__type", F.lit(n)))
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return self.frame(name).filter(F.col("id").isNotNull())

    def links(self, r: Relation) -> DataFrame:
        """(id, source, target, properties) of a relation, predicates of filtered relations applied."""
        if r.base:
            from ..plans.compiler import restrict_links
            from ..plans.match import Match

            base = self.relations[r.base]
            return restrict_links(self, base, self.links(base), Match.of(r.match))
        b = self.bindings[r.name]
        if b.links is not None:
            links = b.links() if callable(b.links) else b.links
            if "id" not in links.columns:
                links = links.withColumn("id", F.concat_ws("-", F.col("source").cast("string"), F.col("target").cast("string")))
            self.bindings[r.name] = replace(b, links=links)
            return links
        holder = r.source if b.holder == "source" else r.target
        rows = self.scan(holder).filter(F.col(b.column).isNotNull())
        me, other = F.col("id"), F.col(b.column)
        return rows.select(F.concat_ws("-", *[(me if b.holder == "source" else other).cast("string"), (other if b.holder == "source" else me).cast("string")]).alias("id"), (me if b.holder == "source" else other).alias("source"), (other if b.holder == "source" else me).alias("target"), *[F.col(p.name) for p in r.properties if p.name in rows.columns])

    def root_relation(self, r: Relation) -> tuple[Relation, list]:
        """The relation under filtered ones, and their predicates."""
        preds = []
        while r.base:
            preds.append(r.match)
            r = self.relations[r.base]
        return r, preds

    def with_frame(self, name: str, df: DataFrame) -> Catalog:
        """The same catalog over other rows of one entity: a later snapshot."""
        out = Catalog(self.spark)
        out.__dict__ |= {k: dict(v) if isinstance(v, dict) else v for k, v in self.__dict__.items()}
        out.frames[name] = (df, "id")
        return out

    def with_links(self, name: str, links: DataFrame) -> Catalog:
        out = Catalog(self.spark)
        out.__dict__ |= {k: dict(v) if isinstance(v, dict) else v for k, v in self.__dict__.items()}
        out.bindings[name] = replace(out.bindings[name], holder="", column="", links=links)
        return out
