"""Schemas that drift between files: profiles, edit scripts, projections.

1. every line is read once into (path, JSON type, value signature) entries,
   counted per file with map-side combining;
2. per file a least-cost edit script leads from the contract to what was seen
   (``functions.tree_edit``); names that never stand beside the contract field
   they may replace, in any file, and that carry like values, are cheap renames;
3. the scripts are compiled into projections that read all files into one table.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Collection, Iterable, Mapping
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.contracts import CONTRACTS, ddl_of
from sedimenta.functions.tree_edit import FORBIDDEN, script
from sedimenta.session import cut

ENTRY = "array<struct<parent:string,name:string,kind:string,sig:string>>"
#: The struct whose fields are judged; other objects are leaves.
JUDGED = "owner"
CHANGE_DDL = "entity string, source_file string, change_kind string, column_path string, seen_path string, lines bigint"
INT32 = 2**31


def _no_constant(token: str) -> None:
    raise ValueError(token)


def strict_object(line: str | None) -> dict | None:
    """The object in ``line`` if it is strict JSON (no NaN or Infinity), else None."""
    try:
        value = json.loads(line, parse_constant=_no_constant)
    except (ValueError, TypeError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def json_kind(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int" if -INT32 <= value < INT32 else "long"
    return {float: "float", str: "str", list: "list", dict: "dict"}[type(value)]


def signature(value: object) -> str:
    """A coarse class of a value, so that like columns have like distributions."""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return f"{'-' if value < 0 else ''}{abs(value).bit_length()}"
    if isinstance(value, str):
        shape = "<" if "<" in value else ":/" if "://" in value else " " if " " in value else "w"
        return f"{shape}{'9' if any(c.isdigit() for c in value) else ''}{min(len(value).bit_length(), 8)}"
    if isinstance(value, list):
        return "l" + (json_kind(value[0]) if value else "")
    return ""


#: JSON kinds that a contract type takes; null is always taken.
TAKES = {"bigint": {"int", "long"}, "int": {"int"}, "boolean": {"bool"}, "array<string>": {"list"}, "struct": {"dict"}}


def taken(contract_type: object, kind: str) -> bool:
    if kind == "null" or contract_type == "string":
        return True
    return kind in TAKES["struct" if isinstance(contract_type, dict) else contract_type]


def _entries(obj: dict) -> list[dict]:
    """The fields of a record and, one level down, of every object in it."""
    out = [{"parent": "", "name": k, "kind": json_kind(v), "sig": signature(v)} for k, v in obj.items()]
    for k, v in obj.items():
        if isinstance(v, dict):
            out += [{"parent": k, "name": c, "kind": json_kind(x), "sig": signature(x)} for c, x in v.items()]
    return out


def _profile(line: pd.Series) -> pd.Series:
    return pd.Series([None if (o := strict_object(x)) is None else _entries(o) for x in line])


NAME = ["entity", "parent", "name"]
FILE = ["entity", "source_file"]


def file_profile(lines: DataFrame, entity: str = "entity", source: str = "_source_file", raw: str = "raw_record") -> DataFrame:
    """(entity, source_file, parent, name, kind, sig, n): what occurs in each file."""
    entries = lines.where(F.col(source).isNotNull() & F.col(entity).isin(list(CONTRACTS))).select(
        F.col(entity).alias("entity"), F.col(source).alias("source_file"), F.explode(F.pandas_udf(_profile, ENTRY)(raw)).alias("e")
    )
    return entries.select("entity", "source_file", "e.*").groupBy(*FILE, "parent", "name", "kind", "sig").agg(F.count(F.lit(1)).alias("n"))


def _words(name: str) -> set[str]:
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)
    words = {p.lower() for p in parts}
    return words - {"is", "has"} or words


def name_distance(a: str, b: str) -> float:
    """0 for the same words in another spelling, 1 for nothing in common."""
    x, y = _words(a), _words(b)
    if not x or not y:
        return 1.0
    shared = sum(max((_stem(p, q) for q in y), default=0.0) for p in x) + sum(max((_stem(p, q) for q in x), default=0.0) for p in y)
    return 1.0 - shared / (len(x) + len(y))


def _stem(p: str, q: str) -> float:
    k = 0
    while k < min(len(p), len(q)) and p[k] == q[k]:
        k += 1
    return k / max(len(p), len(q)) if k >= 3 or p == q else 0.0


def value_distance(a: Counter, b: Counter) -> float:
    """Half the total difference of two signature distributions, beyond what chance gives; 0.5 if either is unknown."""
    na, nb = sum(a.values()), sum(b.values())
    if not na or not nb:
        return 0.5
    total = sum(abs(a[k] / na - b[k] / nb) for k in set(a) | set(b)) / 2
    return max(0.0, total - math.sqrt(len(set(a) | set(b)) / (2 * math.pi) * (1 / na + 1 / nb)))


#: Weights of the evidence for a rename; it is taken below the cost of one deletion and one addition.
W_NAME, W_VALUE, W_CHANCE, DELETE_ADD = 0.5, 0.9, 0.7, 1.0


def live_kinds(seen: Iterable[Mapping]) -> Counter:
    """How often a name holds values of each JSON kind, from its (kind, sig, n) entries."""
    out: Counter = Counter()
    for x in seen:
        out[x["kind"]] += int(x["n"])
    return out


def rename_cost(want: object, path: tuple, name: str, kinds: Counter, mine: Mapping, other: Mapping, children: Collection[str], mandatory: Collection[str]) -> float:
    """Cost of taking ``name`` of a file for the contract field ``path`` of type ``want``.

    ``kinds`` are the JSON kinds of the name in the file, ``mine`` and ``other``
    the statistics of the field and of the name over all files, ``children`` the
    fields of the name where it is an object.  FORBIDDEN if it cannot be the same.
    """
    live = {k: n for k, n in kinds.items() if k != "null"}
    fits = sum(n for k, n in live.items() if (k == "str" if want == "string" else taken(want, k)))
    if fits * 2 < sum(live.values()) or (other.get("beside") or {}).get(".".join(path)):
        return FORBIDDEN  # another type, or both occur side by side in some file
    # the chance that a field absent at this rate misses all files that show the other name
    chance = (1 - mine.get("files", 0) / max(1, mine.get("of", 1))) ** max(1, other.get("files", 1))
    called = name_distance(path[-1], name)
    if isinstance(want, dict):  # a struct is known by its fields
        must = {p.rpartition(".")[2] for p in mandatory if p.startswith(path[-1] + ".")} or set(want)
        value = 1 - len(must & set(children)) / len(must)
    elif want == "boolean":
        value = 0.5  # two flags always look alike
    else:
        value = value_distance(*(Counter({k: n for k, n in (st.get("sigs") or {}).items() if taken(want, k.partition(":")[0])}) for st in (mine, other)))
    return W_NAME * called + W_VALUE * value + W_CHANCE * chance * (min(called, value) if isinstance(want, dict) else called)


def _level(entity: str, parent: str) -> dict[str, object]:
    """The contract fields that the fields of an object are held against: its own, or those of the judged struct."""
    tree = CONTRACTS[entity].tree
    return tree.get(JUDGED, {}) if parent else tree


def _at(parent: str, name: str) -> tuple[str, ...]:
    """The contract path of a field of an object (of the judged struct under whatever name)."""
    return (JUDGED, name) if parent else (name,)


CANDIDATES = "array<struct<lost:string,cost:double>>"


@lru_cache(maxsize=4096)
def _parsed(stats: str) -> dict:
    """The statistics of a name, which are the same text in every file that has it."""
    return json.loads(stats)


def _candidates(of_contract: Mapping[str, Mapping[str, str]]):
    """For each new name the mandatory fields it could be, each at less than a deletion and an addition."""

    def run(entity: pd.Series, parent: pd.Series, name: pd.Series, seen: pd.Series, stats: pd.Series, have: pd.Series, children: pd.Series) -> pd.Series:
        out = []
        for e, p, n, sn, st, h, c in zip(entity, parent, name, seen, stats, have, children, strict=True):
            level, must = _level(e, p), CONTRACTS[e].mandatory
            gone = [k for k in level if ".".join(_at(p, k)) in must and k not in set(h if h is not None else ())]
            costs = []
            for k in gone:
                path = _at(p, k)
                mine = _parsed(of_contract.get(e, {}).get(".".join(path), "{}"))
                cost = rename_cost(level[k], path, n, live_kinds(sn), mine, _parsed(st), c if c is not None else (), must)
                if cost < DELETE_ADD:
                    costs.append({"lost": k, "cost": cost})
            out.append(costs)
        return pd.Series(out)

    return F.pandas_udf(run, CANDIDATES)


def _file_script(pdf: pd.DataFrame, inside: bool, of_contract: Mapping[str, Mapping[str, str]]) -> pd.DataFrame:
    """All changes of one file, from the names that can matter and their statistics."""
    entity, source = pdf["entity"].iloc[0], pdf["source_file"].iloc[0]
    contract = CONTRACTS[entity]
    kinds: dict[tuple, Counter] = {}
    stats: dict[tuple, str] = {}
    declared = of_contract.get(entity, {})
    for parent, name, seen_, st in zip(pdf["parent"], pdf["name"], pdf["seen"], pdf["stats"], strict=True):
        if name is None:  # a file that lacks every field that could matter
            continue
        path = (parent, name) if parent else (name,)
        kinds[path], stats[path] = live_kinds(seen_), st
    seen: dict[str, dict | None] = {p[0]: None for p in kinds if len(p) == 1}
    for p in kinds:
        if len(p) == 2 and p[0] in seen:
            seen[p[0]] = (seen[p[0]] or {}) | {p[1]: None}
    tree = {k: dict.fromkeys(v) if k == JUDGED and isinstance(v, dict) else None for k, v in contract.tree.items()}

    def wanted(path: tuple) -> object:
        at: object = contract.tree
        for part in path:
            at = at.get(part) if isinstance(at, dict) else None
        return at

    def relabel(path: tuple, x: tuple) -> float:
        return rename_cost(wanted(path), path, x[-1], kinds[x], _parsed(declared.get(".".join(path), "{}")), _parsed(stats[x]), (seen.get(x[-1]) or {}) if len(x) == 1 else (), contract.mandatory)

    mandatory = frozenset(tuple(p.split(".")) for p in contract.mandatory)
    _, edits = script(tree, seen, relabel, mandatory=mandatory, delete=DELETE_ADD / 2, add=DELETE_ADD / 2, inside=inside, moves=inside)
    rows = [(e.kind, e.path, e.seen) for e in edits]
    for p, got in kinds.items():
        want = wanted(p) if len(p) == 1 or p[0] == JUDGED else None
        if want is not None and not all(taken(want, k) for k in got):
            rows.append(("type_changed", p, p))
    out = pd.DataFrame([(k, ".".join(p), ".".join(x), sum(kinds[x].values()) if x in kinds else 0) for k, p, x in rows], columns=["change_kind", "column_path", "seen_path", "lines"])
    return out.assign(entity=entity, source_file=source)[["entity", "source_file", "change_kind", "column_path", "seen_path", "lines"]]


def schema_changes(lines: DataFrame, *, inside: bool = False, **columns: str) -> DataFrame:
    """Each change per file: entity, source_file, change_kind, column_path, seen_path, lines.

    ``lines`` holds raw lines of many files (``entity``, ``_source_file``,
    ``raw_record`` or the names given).  Lines that are no JSON objects in
    strict JSON, unknown entities and rows without file are left out; a file of
    only such lines shows no change.  A null line is unreadable.  Repeated rows
    change only ``lines``, the number of lines that show the changed field.

    With ``inside`` the renames of fields of a renamed ``owner`` come as well,
    and fields that moved into or out of it as 'moved' (instead of an addition
    and a removal); the report leaves them out, but a projection needs them.

    A file with any share of all lines is counted by a combining aggregate.
    Every new name of a file that lacks a mandatory field is held against that
    field, as a row; of those that cost less than a deletion and an addition
    only as many of the cheapest as the contract has fields can be in a
    least-cost script, so that many reach the task that makes the script of the
    file, besides the contract's own fields, and all other names are additions.
    Statistics of a name over all files travel with its rows; those of the
    contracts' own fields, as many as these have, go through the driver.
    """
    profile = file_profile(lines, **columns)  # every line is parsed once; what is kept is a row per file and field
    names = cut(profile.groupBy(*FILE, "parent", "name").agg(F.sum("n").alias("lines"), F.collect_list(F.struct("kind", "sig", "n")).alias("seen")))  # kinds and signatures are few
    count = F.count(F.lit(1))
    fields = [(e, "", k) for e, c in CONTRACTS.items() for k in c.tree] + [(e, JUDGED, k) for e, c in CONTRACTS.items() for k in c.tree.get(JUDGED, {})]
    spark = lines.sparkSession
    declared = F.broadcast(spark.createDataFrame(fields, "entity string, parent string, name string"))  # as many rows as the contracts have fields
    own = F.struct(*NAME).isin([F.struct(*map(F.lit, f)) for f in fields])
    nested = {e: list(c.tree.get(JUDGED, {})) for e, c in CONTRACTS.items()}
    kin = F.lit(False)  # a name of the judged struct's fields, under any parent
    elsewhere = F.lit(False)  # a name that the contract has on the other level
    for e, ks in nested.items():
        if ks:
            mine = F.col("entity") == e
            kin = kin | (mine & F.col("name").isin(ks))
            elsewhere = elsewhere | (mine & F.when(F.col("parent") == "", F.col("name").isin(ks)).when(F.col("parent") == JUDGED, F.col("name").isin([k for k in CONTRACTS[e].tree if k not in ks])).otherwise(False))
    path = F.concat_ws(".", F.when(F.col("parent") != "", F.col("parent")), "name")
    per_name = names.withColumn("own", own).withColumn("kin", (F.col("parent") != "") & kin)
    files = names.groupBy(*FILE).agg(F.collect_set(F.when(own, path)).alias("known"))
    beside = (
        per_name.where(~F.col("own")).join(files, FILE)
        .select(*NAME, F.explode("known").alias("k")).groupBy(*NAME, "k").agg(count.alias("n"))
        .groupBy(*NAME).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("beside"))
    )
    sigs = (
        names.select(*NAME, F.explode("seen").alias("x")).where("x.kind <> 'null'").groupBy(*NAME, F.concat_ws(":", "x.kind", "x.sig").alias("sig")).agg(F.sum("x.n").alias("n"))
        .groupBy(*NAME).agg(F.map_from_entries(F.collect_list(F.struct("sig", "n"))).alias("sigs"))
    )
    of = files.groupBy("entity").agg(count.alias("of"))  # one row per contract
    stats = (
        names.groupBy(*NAME).agg(count.alias("files")).join(F.broadcast(of), "entity")
        .join(sigs, NAME, "left").join(beside, NAME, "left")
        .select(*NAME, F.to_json(F.struct("files", "of", "sigs", "beside")).alias("stats"))
    )
    stats = cut(stats)
    of_contract: dict[str, dict[str, str]] = defaultdict(dict)  # as many entries as the contracts have fields
    for r in stats.join(declared, NAME, "left_semi").select("entity", path.alias("path"), "stats").collect():
        of_contract[r["entity"]][r["path"]] = r["stats"]
    # what each object of a file has of the fields it is held against
    have = per_name.where(F.col("own") | F.col("kin")).groupBy(*FILE, "parent").agg(F.collect_set("name").alias("have"))
    children = have.where("parent <> ''").select(*FILE, F.lit("").alias("parent"), F.col("parent").alias("name"), F.col("have").alias("children"))
    extra = per_name.where(~F.col("own") & ~F.col("kin")).join(stats, NAME).join(have, [*FILE, "parent"], "left").join(children, [*FILE, "parent", "name"], "left")
    could = _candidates(of_contract)("entity", "parent", "name", "seen", "stats", "have", "children")
    costs = extra.select(*FILE, "parent", "name", F.explode(could).alias("c")).select(*FILE, "parent", "name", "c.*")
    rank = F.row_number().over(Window.partitionBy(*FILE, "parent", "lost").orderBy("cost", "name"))
    most = max(len(c.mandatory) for c in CONTRACTS.values())
    # what a struct costs depends on its fields as well, so all that could be one go on
    chosen = costs.withColumn("rank", rank).where((F.col("rank") <= most) | (F.col("lost") == JUDGED))
    chosen = cut(chosen.select(*FILE, "parent", "name").distinct())
    rest = per_name.where(~F.col("own") & ~F.col("kin") & ~elsewhere).join(chosen, [*FILE, "parent", "name"], "left_anti")
    judged = (F.col("parent") == JUDGED) & F.col("entity").isin([e for e, ks in nested.items() if ks])
    added = rest.where((F.col("parent") == "") | judged).select(*FILE, F.lit("added").alias("change_kind"), path.alias("column_path"), path.alias("seen_path"), "lines")
    into = chosen.where("parent = ''").select(*FILE, F.col("name").alias("parent"))  # objects that could be the judged struct
    matter = (
        per_name.where(F.col("own") | ((F.col("parent").isin("", JUDGED)) & elsewhere))
        .unionByName(per_name.where((F.col("parent") != "") & (F.col("parent") != JUDGED) & F.col("kin")).join(into, [*FILE, "parent"], "left_semi"))
        .unionByName(per_name.where(~F.col("own") & ~F.col("kin") & ~elsewhere).join(chosen, [*FILE, "parent", "name"], "left_semi"))
    )
    rows = matter.join(stats, NAME).select(*FILE, "parent", "name", "seen", "stats")
    # every file has its row, also if nothing of it matters
    rows = rows.unionByName(files.select(*FILE), allowMissingColumns=True)
    return rows.groupBy(*FILE).applyInPandas(lambda pdf: _file_script(pdf, inside, of_contract), CHANGE_DDL).unionByName(added.select("entity", "source_file", "change_kind", "column_path", "seen_path", "lines"))


def scripts(changes: DataFrame) -> DataFrame:
    """One row per file: the map contract path -> path in the file of its renames and moves."""
    other = changes.where("change_kind IN ('renamed', 'moved')")
    return other.groupBy(*FILE).agg(F.map_from_entries(F.collect_list(F.struct("column_path", "seen_path"))).alias("renames"))


def _readable(line: pd.Series) -> pd.Series:
    return pd.Series([strict_object(x) is not None for x in line], dtype=bool)


def read_consistent(lines: DataFrame, changes: DataFrame, entity: str, *, source: str = "_source_file", raw: str = "raw_record") -> DataFrame:
    """Readable records of ``entity`` in the columns of its contract, whatever their file called them.

    Columns: source_file, then the contract, then ``_rescued_data``.  The rules
    are those of ``read_records``.
    """
    return read_records(lines, changes, (entity,), source=source, raw=raw).drop("entity")


def read_records(lines: DataFrame, changes: DataFrame, entities: Iterable[str] = tuple(CONTRACTS), *, source: str = "_source_file", raw: str = "raw_record") -> DataFrame:
    """Readable records of all ``entities`` as one long table.

    Each file's script is applied as a projection: a contract column is read
    from the name it has in that file and cast, the fields of ``owner``
    likewise; renames in a renamed ``owner`` and moves need ``changes`` with
    ``inside``.  Nothing is lost: a value that the type does not take, and every
    field outside the contract, is kept under its path in the file in
    ``_rescued_data`` (a JSON object of texts; null if there is none).

    Columns: entity, source_file, then every column of the contracts once, in
    their order, and ``_rescued_data``; a column that the entity's contract
    lacks is null.  Lines of other entities are left out.  Every line is read
    once.
    """
    entities = list(entities)
    mine = lines.where(F.col("entity").isin(entities)).select("entity", F.col(source).alias("source_file"), F.col(raw).alias("__raw"))
    fields = mine.where(F.pandas_udf(_readable, "boolean")("__raw")).join(scripts(changes.where(F.col("entity").isin(entities))), FILE, "left")
    fields = fields.withColumn("__j", F.coalesce(F.element_at("renames", F.lit(JUDGED)), F.lit(JUDGED)))  # what the file calls the judged struct
    fields = fields.withColumn("__f", F.from_json("__raw", "map<string,string>")).withColumn("__o", F.from_json(F.element_at("__f", F.col("__j")), "map<string,string>"))

    def place(*path: str) -> Column:
        """Where the file has a contract field."""
        here = F.concat(F.col("__j"), F.lit(f".{path[1]}")) if len(path) > 1 else F.lit(path[0])
        return F.coalesce(F.element_at("renames", F.lit(".".join(path))), here)

    def text(at: Column) -> Column:
        below = F.concat(F.col("__j"), F.lit("."))
        return F.when(F.startswith(at, below), F.element_at("__o", F.substr(at, F.length(below) + 1))).otherwise(F.element_at("__f", at))

    def typed(value: Column, kind: object) -> Column:
        if isinstance(kind, dict):
            return F.from_json(value, ddl_of(kind))
        return F.from_json(value, kind) if kind.startswith("array") else value.try_cast(kind)

    having: dict[str, dict[str, object]] = defaultdict(dict)  # column -> entity -> type
    for e in entities:
        for name, kind in CONTRACTS[e].tree.items():
            having[name][e] = kind
    # contracts agree on the type of a name; a field of this name outside the contract of its entity is no value of the column
    leaves = [((name,), kinds, next(iter(kinds.values()))) for name, kinds in having.items() if name != JUDGED]
    leaves += [((JUDGED, k), having[JUDGED], v) for k, v in next(iter(having.get(JUDGED, {"": {}}).values())).items()]
    applies = [F.col("entity").isin(list(kinds)) for _, kinds, _ in leaves]
    spots = [F.when(ok, place(*path)) for ok, (path, _, _) in zip(applies, leaves, strict=True)]
    fields = fields.withColumns({f"__p{i}": at for i, at in enumerate(spots)}).withColumns({f"__t{i}": text(F.col(f"__p{i}")) for i in range(len(leaves))})
    fields = fields.withColumns({f"__v{i}": typed(F.col(f"__t{i}"), kind) for i, (_, _, kind) in enumerate(leaves)})
    number = {path: i for i, (path, _, _) in enumerate(leaves)}
    # what no column took: values of other types, fields of other names
    spoiled = F.filter(F.array(*[F.when(F.col(f"__v{i}").isNull() & F.col(f"__t{i}").isNotNull(), F.struct(F.col(f"__p{i}").alias("path"), F.col(f"__t{i}").alias("value"))) for i in range(len(leaves))]), lambda x: x.isNotNull())
    used = F.array(*[F.coalesce(F.col(f"__p{i}"), F.lit("")) for i in range(len(leaves))])
    is_struct = F.col("__o").isNotNull() & F.lit(JUDGED in having)
    used_top = F.filter(used, lambda p: ~(is_struct & F.startswith(p, F.concat(F.col("__j"), F.lit(".")))))  # a top key may look like a path into the struct
    top = F.filter(F.map_entries(F.coalesce("__f", F.create_map().cast("map<string,string>"))), lambda x: x["value"].isNotNull() & ~F.array_contains(used_top, x["key"]) & ~(is_struct & (x["key"] == F.col("__j"))))
    low = F.filter(F.map_entries(F.coalesce("__o", F.create_map().cast("map<string,string>"))), lambda x: is_struct & x["value"].isNotNull() & ~F.array_contains(used, F.concat(F.col("__j"), F.lit("."), x["key"])))
    quoted = F.transform(top, lambda x: F.struct(F.when(x["key"].rlike(r"[.\[\]]"), F.concat(F.lit('["'), x["key"], F.lit('"]'))).otherwise(x["key"]).alias("path"), x["value"].alias("value")))
    inner = F.transform(low, lambda x: F.struct(F.concat(F.col("__j"), F.lit("."), x["key"]).alias("path"), x["value"].alias("value")))
    rescued = F.concat(spoiled, quoted, inner)
    fields = fields.withColumn("_rescued_data", F.when(F.size(rescued) > 0, F.to_json(F.map_from_entries(rescued))))
    out = []
    for name, kinds in having.items():
        if name == JUDGED:
            parts = {k: F.col(f"__v{number[JUDGED, k]}") for k in next(iter(kinds.values()))}
            given = F.col("__o").isNotNull() | F.coalesce(*[p.cast("string") for p in parts.values()]).isNotNull()  # its fields may stand elsewhere
            out.append(F.when(F.col("entity").isin(list(kinds)) & given, F.struct(*[p.alias(k) for k, p in parts.items()])).alias(name))
        else:
            out.append(F.col(f"__v{number[(name,)]}").alias(name))
    return fields.select("entity", "source_file", *out, "_rescued_data")
