"""Random predicates over a small model, against plain enumeration of row choices with three truth values."""

import random

import pytest

from kinfold import Catalog, Entity, FilteredEntity, Match, Property, Relation, find

M = Match.atom
NUM = lambda *n: tuple(Property(x, "number") for x in n)
TXT = lambda *n: tuple(Property(x) for x in n)


def world(seed):
    r = random.Random(seed)
    maybe = lambda v, p=0.25: None if r.random() < p else v
    depts = [(i, maybe(r.choice(["east", "west"]), 0.15), maybe(float(r.randint(0, 4)))) for i in range(3)]
    users = [(i, r.choice(["u1", "u2", "u3"]), maybe(float(r.randint(0, 4))), maybe(r.randrange(3), 0.35)) for i in range(6)]
    teams = [(i, r.choice(["hot", "cold", "warm"]), maybe(float(r.randint(0, 4))), maybe(r.randrange(6), 0.2)) for i in range(6)]
    members = [(i, r.choice(["admin", "user"]), maybe(float(r.randint(0, 4))), maybe(r.randrange(6), 0.2)) for i in range(8)]
    collabs = sorted({(r.randrange(6), r.randrange(8)) for _ in range(7)})
    friends = sorted({tuple(sorted(r.sample(range(6), 2))) for _ in range(4)})
    return depts, users, teams, members, collabs, friends


def build(spark, w):
    depts, users, teams, members, collabs, friends = w
    c = Catalog(spark)
    c.entity(Entity("Dept", TXT("region") + NUM("budget")), spark.createDataFrame(depts, "id int, region string, budget double"))
    c.entity(Entity("User", TXT("name") + NUM("rank")), spark.createDataFrame(users, "id int, name string, rank double, dept_id int"))
    c.entity(Entity("Team", TXT("kind") + NUM("size")), spark.createDataFrame(teams, "id int, kind string, size double, owner_id int"))
    c.entity(Entity("Member", TXT("role") + NUM("level")), spark.createDataFrame(members, "id int, role string, level double, team_id int"))
    c.relation(Relation("UserDept", "User", "dept", "Dept", "staff", "n:1"), fk=("source", "dept_id"))
    c.relation(Relation("UserTeams", "User", "teams", "Team", "owner", "1:n"), fk=("target", "owner_id"))
    c.relation(Relation("TeamMembers", "Team", "members", "Member", "team", "1:n"), fk=("target", "team_id"))
    c.relation(Relation("Collabs", "User", "collabs", "Member", "helped", "n:n"), links=spark.createDataFrame(collabs, "source int, target int"))
    c.relation(Relation("Friends", "User", "friends", "User", "friends", "n:n"), links=spark.createDataFrame(friends, "source int, target int"))
    c.view(FilteredEntity("Active", "User", M("rank", ">", 0)))
    return c


FIELDS = {"Dept": ["region", "budget"], "User": ["name", "rank"], "Team": ["kind", "size"], "Member": ["role", "level"]}
RELS = {"User": {"dept": "Dept", "teams": "Team", "collabs": "Member", "friends": "User"}, "Team": {"members": "Member"}, "Dept": {}, "Member": {}}
VALUES = {"region": ["east", "west", "zz"], "name": ["u1", "u2", "zz"], "kind": ["hot", "cold", "warm"], "role": ["admin", "user"]}


class Plain:
    """The semantics written out over lists."""

    def __init__(self, w):
        depts, users, teams, members, collabs, friends = w
        self.rows = {"Dept": [dict(zip(("id", "region", "budget"), x)) for x in depts], "User": [dict(zip(("id", "name", "rank", "dept_id"), x)) for x in users],
                     "Team": [dict(zip(("id", "kind", "size", "owner_id"), x)) for x in teams], "Member": [dict(zip(("id", "role", "level", "team_id"), x)) for x in members]}
        self.collabs, self.friends = collabs, friends

    def go(self, kind, row, rel):
        if row is None:
            return []
        if rel == "dept":
            return [d for d in self.rows["Dept"] if d["id"] == row["dept_id"]]
        if rel == "teams":
            return [t for t in self.rows["Team"] if t["owner_id"] == row["id"]]
        if rel == "members":
            return [m for m in self.rows["Member"] if m["team_id"] == row["id"]]
        if rel == "collabs":
            return [m for m in self.rows["Member"] if (row["id"], m["id"]) in self.collabs]
        return [u for u in self.rows["User"] if tuple(sorted((u["id"], row["id"]))) in self.friends and u["id"] != row["id"]]

    def choices(self, kind, row, paths):
        """All assignments of one record (or None) to each path, children under their parents' choice."""
        out = [{(): row}]
        for p in sorted({p[:i] for p in paths for i in range(1, len(p) + 1)}, key=len):
            nxt = []
            for a in out:
                found = self.go(None, a[p[:-1]], p[-1]) or [None]
                nxt += [a | {p: f} for f in found]
            out = nxt
        return out

    def holds(self, kind, row, exp):
        atoms = [a for a in exp.atoms() if a.op != "exist"]
        paths = {a.segments[:-1] for a in atoms}
        return any(exp.fold(lambda a: self.atom(kind, row, a, c), k_and, k_or, lambda x: None if x is None else not x) is True for c in self.choices(kind, row, paths))

    def atom(self, kind, row, a, choice):
        if a.op == "exist":
            found = [row]
            at = kind
            for s in a.segments:
                found = [y for x in found for y in self.go(at, x, s)]
                at = RELS[at][s]
            return any(self.holds(at, x, a.operand.exp) for x in found)
        rec = choice[a.segments[:-1]]
        v, o = rec[a.segments[-1]] if rec is not None else None, a.operand
        if a.op in ("=", "!=") and o is None:
            return (v is None) == (a.op == "=")
        if a.op == "in":
            rest = [x for x in o if x is not None]
            if None in o and v is None:
                return True
            return False if not rest else None if v is None else v in rest
        if a.op == "not in":
            if not o:
                return True
            if None in o and v is None:
                return False
            rest = [x for x in o if x is not None]
            return True if not rest else None if v is None else v not in rest
        if v is None:
            return None
        if a.op == "between":
            return o[0] <= v <= o[1]
        return {"=": v == o, "!=": v != o, ">": v > o if a.op == ">" else None, "<=": v <= o if a.op == "<=" else None}[a.op]


def k_and(a, b):
    return False if a is False or b is False else None if a is None or b is None else True


def k_or(a, b):
    return True if a is True or b is True else None if a is None or b is None else False


def random_atom(r, kind, depth=0):
    path, at = [], kind
    while RELS[at] and r.random() < 0.55 and len(path) < 2:
        s = r.choice(sorted(RELS[at]))
        path.append(s)
        at = RELS[at][s]
    if path and r.random() < 0.35 and depth < 2:
        return M(".".join(path), "exist", random_exp(r, at, depth + 1))
    f = r.choice(FIELDS[at])
    text = f in VALUES
    val = lambda: r.choice(VALUES[f]) if text else float(r.randint(0, 4))
    op = r.choice(["=", "!=", "in", "not in"] if text else ["=", "!=", ">", "<=", "in", "not in", "between"])
    if op in ("in", "not in"):
        operand = [val() for _ in range(r.randint(0, 2))] + ([None] if r.random() < 0.3 else [])
    elif op == "between":
        operand = sorted([val(), val()])
    else:
        operand = None if op in ("=", "!=") and r.random() < 0.2 else val()
    return M(".".join([*path, f]), op, operand)


def random_exp(r, kind, depth=0):
    n = r.randint(1, 3)
    out = random_atom(r, kind, depth)
    for _ in range(n - 1):
        nxt = random_atom(r, kind, depth)
        out = out.and_(nxt) if r.random() < 0.5 else out.or_(nxt)
        if r.random() < 0.25:
            out = out.not_()
    return out


@pytest.mark.parametrize("seed", range(8))
def test_random_predicates(spark, seed):
    w = world(seed)
    c, plain = build(spark, w), Plain(w)
    r = random.Random(seed * 77 + 1)
    for _ in range(7):
        m = random_exp(r, "User")
        ours = sorted(x[0] for x in find(c, "User", m, attrs=["id"]).collect())
        theirs = sorted(u["id"] for u in plain.rows["User"] if plain.holds("User", u, m.exp))
        assert ours == theirs, m.to_dict()
        assert Match.from_dict(m.to_dict()) == m


def test_view_and_predicate(spark):
    w = world(9)
    c = build(spark, w)
    assert sorted(x[0] for x in find(c, "Active", attrs=["id"]).collect()) == sorted(u[0] for u in w[1] if u[2] is not None and u[2] > 0)


def test_nested_projection_of_all_users(spark):
    from kinfold.plans.query import nested

    w = world(3)
    c, plain = build(spark, w), Plain(w)
    rows = find(c, "User", attrs=["name", nested("dept", ["region"]), nested("teams", ["kind", nested("members", ["role"])]), nested("friends", ["name"])]).collect()
    assert len(rows) == 6
    for x in rows:
        u = plain.rows["User"][x["id"]]
        assert (x["dept"]["region"] if x["dept"] else None) == next((d["region"] for d in plain.go("User", u, "dept")), None)
        assert [t["id"] for t in x["teams"]] == sorted(t["id"] for t in plain.go("User", u, "teams"))
        for t in x["teams"]:
            assert [m["id"] for m in t["members"]] == sorted(m["id"] for m in plain.go("Team", {"id": t["id"]}, "members"))
        assert sorted(f["id"] for f in x["friends"]) == sorted(f["id"] for f in plain.go("User", u, "friends"))
