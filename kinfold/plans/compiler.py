"""Predicates to DataFrame plans.

Value atoms on one path share one row of a fan-out (left joins); a root matches if some choice of rows makes the tree true. Existence
atoms are two-valued per root: semi joins where they must hold, anti joins where they must not, flags elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ModelError, Property
from ..sources.catalog import Catalog, End
from .boolexp import ATOM, NOT, BoolExp
from .match import LINK, Atom, Match, atom_column

#: Between the parts of a joined column's name.
SEP = "·"


def name_of(path: tuple[str, ...], prop: str) -> str:
    return SEP.join((*path, prop))


def column(path: tuple[str, ...], prop: str) -> Column:
    return F.col(f"`{name_of(path, prop)}`")


def prefixed(df: DataFrame, path: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(name_of(path, c)) for c in df.columns])


def resolve(cat: Catalog, entity: str, segments: tuple[str, ...]) -> tuple[list[tuple[tuple[str, ...], End]], tuple[str, ...], Property | None]:
    """(hops with their paths, path of the last record or link, property) of a dotted path."""
    hops, at, where = [], entity, ()
    for i, s in enumerate(segments[:-1]):
        if s == LINK:
            if not hops or i != len(segments) - 2:
                raise ModelError(f"& follows a relation and comes before its property: {'.'.join(segments)}")
            r = cat.root_relation(hops[-1][1].relation)[0]
            return hops, (*where, LINK), next((p for p in r.properties if p.name == segments[-1]), None)
        end = cat.end(at, s)
        if end is None:
            raise ModelError(f"{s} is not a relation of {at}")
        where = (*where, s)
        hops.append((where, end))
        at = end.target
    return hops, where, cat.property(at, segments[-1])


def fk_of(cat: Catalog, end: End) -> tuple[str, str] | None:
    """("here" or "there", column) if the relation is a foreign key and, where filtered, filtered by its target side only."""
    r, preds = cat.root_relation(end.relation)
    b = cat.bindings[r.name]
    if b.links is not None:
        return None
    here = b.holder == ("source" if end.forward else "target")
    side = "target" if end.forward else "source"
    if preds and (here or not all(p.startswith(f"{side}.") for m in preds for p in Match.of(m).paths())):
        return None
    return ("here" if here else "there", b.column)


def target_rows(cat: Catalog, end: End) -> DataFrame:
    """Rows on the other side of a foreign key held there, predicates of filtered relations applied in place."""
    df, side = cat.scan(end.target), "target" if end.forward else "source"
    for m in cat.root_relation(end.relation)[1]:
        strip = len(side) + 1
        inner = Match(Match.of(m).exp.map(lambda a: Atom(a.path[strip:], a.op, a.operand, a.reference)))
        df = restrict(cat, end.target, df, inner)
    return df


def oriented_links(cat: Catalog, end: End) -> DataFrame:
    """(_src, _dst, &-columns) of a relation from this end; symmetric ones in both directions."""
    links = cat.links(end.relation)
    a, b = ("source", "target") if end.forward else ("target", "source")
    rest = [F.col(c).alias(name_of((LINK,), c)) for c in links.columns if c not in ("source", "target")]
    one = links.select(F.col(a).alias("_src"), F.col(b).alias("_dst"), *rest)
    if cat.root_relation(end.relation)[0].symmetric:
        one = one.unionByName(links.filter("source <> target").select(F.col(b).alias("_src"), F.col(a).alias("_dst"), *rest))
    return one


def hop_rows(cat: Catalog, end: End, need_target: bool = True) -> DataFrame:
    """(_src, the target's columns, &-columns) for relations that are not a foreign key of this side."""
    fk = fk_of(cat, end)
    if fk and fk[0] == "there":
        return target_rows(cat, end).withColumn("_src", F.col(fk[1]))
    links = oriented_links(cat, end)
    if not need_target:  # the link has the id already
        return links.withColumnRenamed("_dst", "id")
    return links.join(cat.scan(end.target), F.col("_dst") == F.col("id")).drop("_dst")


def join_hop(cat: Catalog, df: DataFrame, before: tuple[str, ...], path: tuple[str, ...], end: End, only_id: bool = False, how: str = "left") -> DataFrame:
    """df with the records of a hop joined under the names of `path`."""
    fk = fk_of(cat, end)
    if fk and fk[0] == "here":
        if only_id:  # the key is the id
            return df.withColumn(name_of(path, "id"), column(before, fk[1]))
        other = prefixed(cat.scan(end.target), path)
        return df.join(other, column(before, fk[1]) == column(path, "id"), how)
    other = prefixed(hop_rows(cat, end, not only_id), path)
    return df.join(other, column(before, "id") == column(path, "_src"), how)


def _needs(cat: Catalog, entity: str, atoms: list[Atom], root: dict | None) -> dict[tuple[str, ...], tuple[End, set[str]]]:
    """The hops that value atoms read, parents first, with the properties read there."""
    out: dict[tuple[str, ...], tuple[End, set[str]]] = {}
    for a in atoms:
        paths = [a.segments]
        if a.reference and root is None:
            paths += [tuple(p.split(".")) for p in (a.operand if isinstance(a.operand, (list, tuple)) else [a.operand])]
        for segments in paths:
            hops, where, _ = resolve(cat, entity, segments)
            for path, end in hops:
                out.setdefault(path, (end, set()))
            if hops:
                out[hops[-1][0]][1].add(segments[-1] if where[-1] != LINK else name_of((LINK,), segments[-1]))
    return dict(sorted(out.items(), key=lambda x: len(x[0])))


def many_paths(cat: Catalog, entity: str, a: Atom) -> set[tuple[str, ...]]:
    hops, _, _ = resolve(cat, entity, a.segments)
    return {path for path, end in hops if end.many}


def value_column(cat: Catalog, entity: str, a: Atom, root: dict | None) -> Column:
    hops, where, prop = resolve(cat, entity, a.segments)
    own = column(where[:-1], name_of((LINK,), a.segments[-1])) if where and where[-1] == LINK else column(where, a.segments[-1])
    refer = None
    if a.reference:
        def refer(p: str) -> Column:
            if root is not None:
                return F.col(f"`{root[p]}`")
            seg = tuple(p.split("."))
            w = resolve(cat, entity, seg)[1]
            return column(w, seg[-1])
    return atom_column(own, a.op, a.operand, prop, refer)


def tree_column(cat: Catalog, entity: str, exp: BoolExp, root: dict | None, flags: dict[Atom, str]) -> Column:
    atom = lambda a: F.coalesce(F.col(flags[id(a)]), F.lit(False)) if a.op == "exist" else value_column(cat, entity, a, root)
    return exp.fold(atom, lambda x, y: x & y, lambda x, y: x | y, lambda x: ~x)


def restrict(cat: Catalog, entity: str, df: DataFrame, match: Match, keys: list[str] | None = None, root: dict | None = None, depth: int = 0) -> DataFrame:
    """The rows of df (records of `entity`) for which the predicate is true, each once.

    keys identify a row. root maps paths from the outermost root to columns that df carries; None if df's rows are the roots."""
    keys = keys or ["id"]
    groups: list[tuple[set, list[BoolExp]]] = []
    for c in match.exp.conjuncts():
        mine = set().union(*[many_paths(cat, entity, a) for a in c.atoms() if a.op != "exist"], set())
        touching = [g for g in groups if g[0] & mine]
        merged = (mine.union(*[g[0] for g in touching]), [e for g in touching for e in g[1]] + [c])
        groups = [g for g in groups if g not in touching] + [merged]
    # cheap ones first: no relation, then existence, then fan-outs
    for many, exps in sorted(groups, key=lambda g: (len(g[0]), any(a.op == "exist" for e in g[1] for a in e.atoms()))):
        df = _group(cat, entity, df, exps, many, keys, root, depth)
    return df


def _group(cat: Catalog, entity: str, df: DataFrame, exps: list[BoolExp], many: set, keys: list[str], root: dict | None, depth: int) -> DataFrame:
    if len(exps) == 1:
        e, negated = exps[0], False
        while e.op == NOT:
            e, negated = e.left, not negated
        if e.op == ATOM and e.left.op == "exist":
            found = exist_keys(cat, entity, df, e.left, keys, root, depth)
            return df.join(found, keys, "left_anti" if negated else "left_semi")
    exp = BoolExp.all(*exps)
    atoms = list(exp.atoms())
    work, flags = df, {}
    for i, a in enumerate(x for x in atoms if x.op == "exist"):
        flags[id(a)] = f"_flag{depth}_{i}"
        found = exist_keys(cat, entity, df, a, keys, root, depth).distinct().withColumn(flags[id(a)], F.lit(True))
        work = work.join(found, keys, "left")
    values = [x for x in atoms if x.op != "exist"]
    for path, (end, props) in _needs(cat, entity, values, root).items():
        only_id = props == {"id"} and not any(len(p) > len(path) and p[: len(path)] == path for p in _needs(cat, entity, values, root))
        work = join_hop(cat, work, path[:-1], path, end, only_id)
    work = work.filter(tree_column(cat, entity, exp, root, flags))
    if not many:
        return work.select(*[F.col(f"`{c}`") for c in df.columns]) if work.columns != df.columns else work
    return df.join(work.select(*keys), keys, "left_semi")


def exist_keys(cat: Catalog, entity: str, df: DataFrame, a: Atom, keys: list[str], root: dict | None, depth: int) -> DataFrame:
    """keys of the rows that reach a record by the path for which the inner predicate is true; keys may repeat."""
    inner, at, ends = Match.of(a.operand), entity, []
    for s in a.segments:
        end = cat.end(at, s)
        if end is None:
            raise ModelError(f"{s} is not a relation of {at}")
        ends.append(end)
        at = end.target
    refs = sorted(_references(inner))
    carried = [f"_k{depth}_{i}" for i in range(len(keys))]
    fk = fk_of(cat, ends[0])
    if not refs and keys == ["id"] and not (fk and fk[0] == "here"):
        # start at the far side: the first hop has this side's id
        cur = hop_rows(cat, ends[0], len(ends) == 1 or (fk_of(cat, ends[1]) or ("",))[0] == "here").withColumnRenamed("_src", carried[0])
        roots: dict | None = root
    else:
        start = df
        roots = dict(root) if root is not None else {}
        if root is None:
            seen: set[tuple[str, ...]] = set()
            for r in refs:  # what the outermost root is asked for
                seg = tuple(r.split("."))
                hops, where, _ = resolve(cat, entity, seg)
                for path, end in hops:
                    if path not in seen:
                        if end.many:
                            raise ModelError(f"{r}: a reference goes over relations to one only")
                        start = join_hop(cat, start, path[:-1], path, end)
                        seen.add(path)
                roots[r] = f"_root_{SEP.join(seg)}"
                start = start.withColumn(roots[r], column(where, seg[-1]))
        keep = [*[F.col(k).alias(c) for k, c in zip(keys, carried)], *[F.col(f"`{c}`") for c in dict.fromkeys(roots.values())]]
        if fk and fk[0] == "here":
            cur = start.select(*keep, F.col(fk[1]).alias("_fk")).join(cat.scan(ends[0].target), F.col("_fk") == F.col("id")).drop("_fk")
        else:
            cur = start.select(*keep, F.col("id").alias("_id")).join(hop_rows(cat, ends[0]), F.col("_id") == F.col("_src")).drop("_id", "_src")
    own = [c for c in cur.columns if c in carried or c in set((roots or {}).values())]
    for end in ends[1:]:
        fk = fk_of(cat, end)
        if fk and fk[0] == "here":
            cur = cur.select(*[F.col(f"`{c}`") for c in own], F.col(fk[1]).alias("_fk")).join(cat.scan(end.target), F.col("_fk") == F.col("id")).drop("_fk")
        else:
            cur = cur.select(*[F.col(f"`{c}`") for c in own], F.col("id").alias("_id")).join(hop_rows(cat, end), F.col("_id") == F.col("_src")).drop("_id", "_src")
    cur = restrict(cat, at, cur, inner, [*carried, "id"], roots if roots is not None else {}, depth + 1)
    return cur.select(*[F.col(c).alias(k) for k, c in zip(keys, carried)])


def _references(m: Match) -> set[str]:
    out: set[str] = set()
    for a in m.exp.atoms():
        if a.op == "exist":
            out |= _references(Match.of(a.operand))
        elif a.reference:
            out |= set(a.operand if isinstance(a.operand, (list, tuple)) else [a.operand])
    return out


def restrict_links(cat: Catalog, r, links: DataFrame, match: Match) -> DataFrame:
    """Links for which a predicate over their properties, source.* and target.* is true."""
    work = links
    for side, ent in (("source", r.source), ("target", r.target)):
        atoms = [a for a in match.exp.atoms() if a.segments[0] == side]
        if any(len(a.segments) > 2 for a in atoms):
            raise ModelError("a filtered relation reads its own ends and properties only")
        if any(a.segments[1] != "id" for a in atoms):
            work = work.join(prefixed(cat.scan(ent), (side,)), F.col(side) == column((side,), "id"), "left")
        elif atoms:
            work = work.withColumn(name_of((side,), "id"), F.col(side))

    def atom(a: Atom) -> Column:
        s = a.segments
        if s[0] in ("source", "target"):
            return atom_column(column((s[0],), s[1]), a.op, a.operand, cat.property(r.source if s[0] == "source" else r.target, s[1]))
        return atom_column(F.col(s[0]), a.op, a.operand, next((p for p in r.properties if p.name == s[0]), None))

    return work.filter(match.exp.fold(atom, lambda x, y: x & y, lambda x, y: x | y, lambda x: ~x)).select(*links.columns)
