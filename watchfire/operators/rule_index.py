"""Many rules at once, found by what an event must have to match them: tested in batches (hits()), or as rows of a table, which
say what an index lets through (candidates())."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfire.functions import rules as R
from watchfire.functions.rules import Rule
from watchfire.sources.security_events import EVENT_FIELDS

#: Rules of one pass over events; their table is broadcast.
RULES_A_PASS = 5000
#: The key that all events have: for rules without a necessary value.
ANY = "*"
#: How telling an equal value of a field is, most first; other fields and long literals are as telling as the first ones.
_COMMON = {"event_type": 2, "source": 3, "severity": 4}
_LITERAL = 4
_TEST = "struct<field:int,path:string,op:string,texts:array<string>,numbers:array<double>>"
_RULE = f"rule_id string, key string, keys array<string>, selections array<array<{_TEST}>>, program array<int>, stages array<int>"
_COMPARED = ("gt", "gte", "lt", "lte")
_NOT, _AND, _OR = -1, -2, -3

Key = tuple[str, str, str]  # field, "=" or "~" (a literal in it), value


def _flat(expected: Any) -> Iterator[Any]:
    for e in expected if isinstance(expected, (list, tuple)) else [expected]:
        if isinstance(e, (list, tuple)):
            yield from _flat(e)
        else:
            yield e


def _limits(values: list) -> Iterator[float]:
    for v in values:
        try:
            limit = float(v)
        except (TypeError, ValueError):
            continue
        if limit == limit:
            yield limit


def _test(name: str, expected: Any, fields: list[str]) -> dict | None:
    """A selection's entry as data: it holds if the field compares with any of the values. None: a pattern that only
    Python can read."""
    path, _, op = name.partition("|")
    values = list(_flat(expected))
    head, *rest = path.split(".")
    out = {"field": -1, "path": None, "op": op, "texts": [], "numbers": []}
    if head != "raw_data" and head in EVENT_FIELDS or path == "raw_data":
        out["field"] = fields.index(head) if not rest else len(fields)  # beyond all fields: null
    else:
        out["path"] = R.json_path(path)
    if op == "exists":
        out["texts"] = ["yes" if v else "no" for v in values]
    elif op in _COMPARED:
        out["numbers"] = list(_limits(values))
    elif op in ("re", "regex"):
        known = [R.java_pattern(str(v)) for v in values]
        if any(k is None for k in known):
            return None
        out |= {"op": "re", "texts": [k for k in known if k]}
    else:
        out |= {"op": op if op in ("contains", "startswith", "endswith") else "equals", "texts": [str(v).lower() for v in values]}
    return out


def _program(tree: tuple, names: list[str]) -> list[int]:
    """The condition in postfix order: selections by number, operators below zero."""
    kind, *parts = tree
    if kind == "is":
        return [names.index(parts[0])]
    return [x for p in parts for x in _program(p, names)] + [{"not": _NOT, "and": _AND, "or": _OR}[kind]]


def _telling(keys: set[Key]) -> tuple[int, int]:
    rank = lambda k: _COMMON.get(k[0], 0) if k[1] == "=" else max(0, _LITERAL - len(k[2]) // 2)
    return max(map(rank, keys)), len(keys)


def _of_entry(name: str, expected: Any) -> set[Key] | None:
    path, _, op = name.partition("|")
    if path not in EVENT_FIELDS or op in ("exists", "re", "regex", *_COMPARED):
        return None
    values = [str(v).lower() for v in _flat(expected)]
    if op in ("contains", "startswith", "endswith"):
        return {(path, "~", v) for v in values} if values and all(values) else None
    return {(path, "=", v) for v in values} if values else None


def necessary(rule: Rule) -> set[Key] | None:
    """Keys of which an event must have one to match the rule; of all such sets the most telling. None: there is none."""

    def of(tree: tuple) -> set[Key] | None:
        kind, *parts = tree
        if kind == "not":
            return None
        if kind == "is":
            found = [k for e in (rule.detection.get(parts[0]) or {}).items() if (k := _of_entry(*e))]
        elif kind == "and":
            found = [k for p in parts if (k := of(p))]
        else:
            each = [of(p) for p in parts]
            return set().union(*each) if all(each) else None
        return min(found, key=_telling, default=None)

    tree = rule.condition()
    return of(tree) if tree else set()


def as_row(rule: Rule, fields: list[str]) -> tuple | None:
    """The rule as data: keys, selections' tests, condition and stages; None if it needs a pattern that only Python reads."""
    names = rule.selection_names()
    selections = [[_test(k, v, fields) for k, v in (rule.detection.get(n) or {}).items()] for n in names]
    if any(t is None for s in selections for t in s):
        return None
    tree, keys = rule.condition(), necessary(rule)
    if tree is None:
        return rule.id, [], selections, [], []
    stages = [names.index(s) for s in rule.stages] if rule.kind == "sequence" else []
    return rule.id, sorted(map("".join, keys)) if keys else [ANY], selections, _program(tree, names), stages


@lru_cache(maxsize=64)
def _automaton(literals: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for x in literals:
        found.add_word(x, x)
    found.make_automaton()
    return found


def literals_in(text: Column, prefix: str, literals: list[str]) -> Column:
    """The keys of those literals that the text has, by one pass of an Aho-Corasick automaton over it (Arrow batches)."""
    wanted = tuple(sorted(set(literals)))

    @F.pandas_udf("array<string>")
    def found(values: pd.Series) -> pd.Series:
        automaton = _automaton(wanted)
        return pd.Series([sorted({prefix + x for _, x in automaton.iter(v)}) if isinstance(v, str) else None for v in values], dtype=object)

    return found(text)


def _used_fields(rules: list[Rule]) -> list[str]:
    heads = {name.partition("|")[0].split(".")[0] for r in rules for s in r.selection_names() for name in (r.detection.get(s) or {})}
    return [c for c in EVENT_FIELDS if c in heads]


def _event_keys(keys: set[str]) -> Column:
    """The keys that an event has, of those that rules ask for."""
    asked: dict[tuple[str, str], list[str]] = {}
    for k in keys - {ANY}:
        field = next(f for f in EVENT_FIELDS if k.startswith((f"{f}=", f"{f}~")))
        asked.setdefault((field, k[len(field)]), []).append(k[len(field) + 1 :])
    equal = [F.concat(F.lit(f"{f}="), F.lower(F.col(f).cast("string"))) for (f, how) in asked if how == "="]
    parts = [F.array_compact(F.array(*equal, *([F.lit(ANY)] if ANY in keys else [])))] if equal or ANY in keys else []
    empty = F.array().cast("array<string>")
    parts += [F.coalesce(literals_in(F.lower(F.col(f).cast("string")), f"{f}~", xs), empty) for (f, how), xs in asked.items() if how == "~"]
    return F.concat(*parts) if parts else empty


Test = tuple[tuple[str, str], str, list]  # (source: an event field or a path in the raw JSON, form), operator, values


def _asked(name: str, expected: Any) -> Test:
    """A selection's entry as a test of one column. Forms: low (the text in lower case), text, number."""
    path, _, op = name.partition("|")
    values = list(_flat(expected))
    if op == "exists":
        return (path, "low"), op, [bool(v) for v in values]
    if op in _COMPARED:
        return (path, "number"), op, list(_limits(values))
    if op in ("re", "regex"):
        return (path, "text"), "re", [str(v) for v in values if R.java_pattern(str(v)) != ""]
    return (path, "low"), op if op in ("contains", "startswith", "endswith") else "equals", [str(v).lower() for v in values]


#: Tests of a selection go in this order: comparisons of codes and numbers first, patterns last.
_COST = {"contains": 1, "startswith": 1, "endswith": 1, "re": 2}


def _column(source: tuple[str, str]) -> Column:
    text = R.event_field(source[0])
    return {"low": F.lower, "number": R.number}.get(source[1], lambda c: c)(text)


class _Batch:
    """Columns of a batch of events; texts as codes of their distinct values, -1 for null."""

    def __init__(self, columns: dict[tuple[str, str], pa.Array], n: int):
        self.columns, self.n, self.kept = columns, n, {}

    def _once(self, key: tuple, make: Callable[[], Any]) -> Any:
        if key not in self.kept:
            self.kept[key] = make()
        return self.kept[key]

    def coded(self, source: tuple[str, str]) -> tuple[np.ndarray, list[str], dict[str, int]]:
        def make():
            found = self.columns[source].dictionary_encode()
            values = found.dictionary.to_pylist()
            return found.indices.fill_null(-1).to_numpy(zero_copy_only=False), values, {v: i for i, v in enumerate(values)}

        return self._once(("codes", source), make)

    def numbers(self, source: tuple[str, str]) -> np.ndarray:
        return self._once(("numbers", source), lambda: self.columns[source].cast(pa.float64()).to_numpy(zero_copy_only=False))

    def rows(self, source: tuple[str, str], code: int) -> np.ndarray:
        def make():
            codes = self.coded(source)[0]
            order = np.argsort(codes, kind="stable")
            return order, np.searchsorted(codes[order], np.arange(len(self.coded(source)[1]) + 1))

        order, starts = self._once(("rows", source), make)
        return order[starts[code] : starts[code + 1]]

    def with_literals(self, source: tuple[str, str], literals: tuple[str, ...]) -> dict[str, list[int]]:
        """For each literal the codes of the texts that have it, by one pass of an Aho-Corasick automaton over them."""

        def make():
            out: dict[str, list[int]] = {}
            automaton = _automaton(literals)
            for code, v in enumerate(self.coded(source)[1]):
                for x in {x for _, x in automaton.iter(v)}:
                    out.setdefault(x, []).append(code)
            return out

        return self._once(("literals", source), make)

    def holds(self, test: Test, rows: np.ndarray) -> np.ndarray:
        """Whether a test holds for these rows: the same comparisons as functions.rules.compare()."""
        source, op, wanted = test
        if op in _COMPARED:
            x = self.numbers(source)[rows]
            compare = {"gt": np.greater, "gte": np.greater_equal, "lt": np.less, "lte": np.less_equal}[op]
            return reduce(np.logical_or, [compare(x, limit) for limit in wanted], np.zeros(len(rows), bool))
        codes, values, place = self.coded(source)
        codes = codes[rows]
        if op == "exists":
            return reduce(np.logical_or, [(codes >= 0) == w for w in wanted], np.zeros(len(rows), bool))
        if op == "equals":
            known = [place[w] for w in wanted if w in place]
            return codes == known[0] if len(known) == 1 else np.isin(codes, known)
        if op == "re":
            found = [re.compile(w, re.I).search for w in wanted]
            check = lambda v: len(v) <= R.MAX_VALUE and any(f(v) is not None for f in found)
        else:
            check = {"contains": lambda v: any(w in v for w in wanted), "startswith": lambda v: v.startswith(tuple(wanted)), "endswith": lambda v: v.endswith(tuple(wanted))}[op]
        truth = np.zeros(len(values) + 1, bool)  # the last place is that of null
        for code in np.unique(codes).tolist():
            if code >= 0:
                truth[code] = check(values[code])
        return truth[codes]

    def selected(self, tests: list[Test], rows: np.ndarray) -> np.ndarray:
        out = np.ones(len(rows), bool)
        for t in tests:
            left = np.flatnonzero(out)
            if not len(left):
                break
            out[left] = self.holds(t, rows[left])
        return out

    def true(self, tree: tuple, selections: dict[str, list[Test]], rows: np.ndarray) -> np.ndarray:
        kind, *parts = tree
        if kind == "is":
            return self.selected(selections[parts[0]], rows)
        out = self.true(parts[0], selections, rows)
        if kind == "not":
            return ~out
        # Of "and" the second part is asked of the rows that hold so far, of "or" of the others.
        left = np.flatnonzero(out if kind == "and" else ~out)
        if len(left):
            out[left] = self.true(parts[1], selections, rows[left])
        return out


HITS = "array<struct<part:int,hits:array<struct<rule:int,mask:bigint>>>>"
CODES = "array<struct<part:int,codes:binary>>"

#: The rows of a batch that a rule matches, by its place in the pack, and for each of its stages whether they fit it.
Tested = Iterator[tuple[int, np.ndarray, list[np.ndarray]]]


def _tester(rules: list[Rule]) -> tuple[list[tuple[str, str]], Callable[[_Batch], Tested]]:
    """(the columns that tests read, the test of a batch). A rule looks only at the rows that have one of its necessary()
    keys, each distinct text of them is tested once, and a selection's next test sees only the rows that the last one left.
    Lower case, numbers and fields of the raw JSON are made by Spark, once an event."""
    plans, literals = [], {}
    for i, r in enumerate(rules):
        keys, tree = necessary(r), r.condition()
        if tree is not None and (keys is None or keys):
            tests = {n: sorted((_asked(*e) for e in (r.detection.get(n) or {}).items()), key=lambda t: _COST.get(t[1], 0)) for n in r.selection_names()}
            plans.append((i, keys, tree, tests, r.stages if r.kind == "sequence" else []))
            for field, how, value in keys or ():
                if how == "~":
                    literals.setdefault(field, set()).add(value)
    literals = {f: tuple(sorted(v)) for f, v in literals.items()}

    def candidates_of(batch: _Batch, keys: set[Key] | None) -> np.ndarray:
        if keys is None:
            return np.arange(batch.n)
        found = []
        for field, how, value in keys:
            source = (field, "low")
            codes = batch.with_literals(source, literals[field]).get(value, []) if how == "~" else [c for c in [batch.coded(source)[2].get(value)] if c is not None]
            found += [batch.rows(source, c) for c in codes]
        if len(found) < 2:
            return found[0] if found else np.empty(0, np.int64)
        met = np.zeros(batch.n, bool)
        met[np.concatenate(found)] = True
        return np.flatnonzero(met)

    def tested(batch: _Batch) -> Tested:
        for i, keys, tree, tests, stages in plans:
            at = candidates_of(batch, keys)
            at = at[batch.true(tree, tests, at)] if len(at) else at
            if len(at):
                yield i, at, [batch.selected(tests[name], at) for name in stages]

    return sorted({t[0] for p in plans for tests in p[3].values() for t in tests}), tested


def _joined(found: list[list[np.ndarray]], types: tuple) -> list[np.ndarray]:
    return [np.concatenate([*x, np.empty(0, t)]).astype(t) for x, t in zip(found, types)]


def _by_event_and_part(row: np.ndarray, part: np.ndarray, n: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Of sorted hits: (where each list of an event and part begins, with the end; where each event's lists begin; parts)."""
    starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])][: len(row)])
    per_event = np.r_[0, np.cumsum(np.bincount(row[starts], minlength=n))].astype(np.int32)
    return np.r_[starts, len(row)], pa.array(per_event), pa.array(part[starts])


def hits(rules: list[Rule], parts: list[int] | None = None) -> Column:
    """For each event its matches (rule: the place in rules; mask: a bit for each stage that it fits), in lists by the rules'
    parts (all 0 if None), in order of part and rule. Arrow batches, tested as _tester() says."""
    sources, tested = _tester(rules)
    parts_of = np.array(parts or [0] * len(rules), np.int32)

    @F.arrow_udf(HITS)
    def found(*columns: pa.Array) -> pa.Array:
        batch = _Batch(dict(zip(sources, columns)), len(columns[0]))
        rows, rule, mask = [], [], []
        for i, at, stages in tested(batch):
            rows.append(at)
            rule.append(np.full(len(at), i, np.int32))
            mask.append(reduce(np.bitwise_or, [fits.astype(np.int64) << k for k, fits in enumerate(stages)], np.zeros(len(at), np.int64)))
        row, rule, mask = _joined([rows, rule, mask], (np.int64, np.int32, np.int64))
        order = np.lexsort((rule, parts_of[rule], row))
        row, rule, mask = row[order], rule[order], mask[order]
        ends, per_event, part = _by_event_and_part(row, parts_of[rule], batch.n)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(rule), pa.array(mask)], ["rule", "mask"]))
        return pa.ListArray.from_arrays(per_event, pa.StructArray.from_arrays([part, lists], ["part", "hits"]))

    return found(*[_column(s) for s in sources] or [F.lit("")])


def code_type(n: int) -> np.dtype:
    """The type of codes of which there are n."""
    return np.dtype("<u2" if n <= 1 << 16 else "<u4")


def coded_hits(rules: list[Rule], parts: list[int], codes: list[int], n_codes: int) -> Column:
    """hits() in a short form: for each event and part one binary, the codes of what it matches, each of code_type(n_codes). A
    rule's code is codes[its place]; of a sequence rule stage k that an event fits has that code plus k."""
    sources, tested = _tester(rules)
    kind = code_type(n_codes)

    @F.arrow_udf(CODES)
    def found(*columns: pa.Array) -> pa.Array:
        batch = _Batch(dict(zip(sources, columns)), len(columns[0]))
        rows, part, code = [], [], []
        for i, at, stages in tested(batch):
            for k, fitting in enumerate([at[fits] for fits in stages] if rules[i].kind == "sequence" else [at]):
                rows.append(fitting)
                part.append(np.full(len(fitting), parts[i], np.int32))
                code.append(np.full(len(fitting), codes[i] + k, kind))
        row, part, code = _joined([rows, part, code], (np.int64, np.int32, kind))
        order = np.argsort(row * (max(parts, default=0) + 1) + part, kind="stable")
        row, part, code = row[order], part[order], code[order]
        ends, per_event, part = _by_event_and_part(row, part, batch.n)
        packed = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * kind.itemsize).astype(np.int32)), pa.py_buffer(code)])
        return pa.ListArray.from_arrays(per_event, pa.StructArray.from_arrays([part, packed], ["part", "codes"]))

    return found(*[_column(s) for s in sources] or [F.lit("")])


def indexed(spark: SparkSession, rules: list[Rule]) -> tuple[DataFrame, list[str], set[str], list[Rule]]:
    """(a row for each rule and key, the event fields that tests read, all keys, the rules that have no such row)."""
    fields = _used_fields(rules)
    rows, left = [], []
    for r in rules:
        row = as_row(r, fields)
        if row is None:
            left.append(r)
        else:
            rows += [(row[0], k, *row[1:]) for k in row[1]]
    return spark.createDataFrame(rows, _RULE), fields, {r[1] for r in rows}, left


def candidates(events: DataFrame, index: DataFrame, keys: set[str]) -> DataFrame:
    """(event, rule) pairs that share a key, each once; of a rule with several keys the event's first counts."""
    keyed = events.withColumn("event_keys", _event_keys(keys)).withColumn("key", F.explode("event_keys"))
    once = (F.size("keys") == 1) | (F.get(F.array_intersect("event_keys", "keys"), F.lit(0)) == F.col("key"))
    return keyed.join(F.broadcast(index), "key").where(once)


def indexed_matches(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """(events' columns, rule_id, mask) of all rules: hits() of the events, with the rules' ids by a broadcast join. No shuffle."""
    ids = events.sparkSession.createDataFrame(list(enumerate(r.id for r in rules)), "rule int, rule_id string")
    found = events.withColumn("found", hits(rules)).select(*events.columns, F.inline(F.flatten("found.hits")))
    return found.join(F.broadcast(ids), "rule").select(*events.columns, "rule_id", "mask")


__all__ = ["HITS", "RULES_A_PASS", "candidates", "code_type", "coded_hits", "hits", "indexed", "indexed_matches", "literals_in", "necessary"]
