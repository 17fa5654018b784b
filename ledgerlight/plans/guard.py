"""Guarded SQL: one read-only query over approved tables, allowed functions, and joins proved against the model.

Statement rules look at the parsed plan, before anything is resolved. Joins are proved on the analysed plan, where every
column has an identity: a column keeps its origin (scan, table, column) through aliases, sub-queries, common table expressions and
unions, and loses it when it is computed. Works on classic sessions, whose plans Python can reach.
"""

from __future__ import annotations

import re
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.model import Model

MAX_CHARS, MAX_SECONDS = 30_000, 60.0
# The functions that a query may call.
FUNCTIONS = frozenset(
    "and or case if exists cast try_cast coalesce nullif greatest least round abs ceil ceiling floor power pow sqrt exp ln sign mod log log10 year month day dayofmonth hour minute second extract date_part datepart date to_date date_trunc trunc strftime date_format to_timestamp try_to_timestamp "
    "date_add date_sub dateadd datediff date_diff last_day make_date current_date current_timestamp epoch unix_timestamp lower upper length char_length trim btrim ltrim rtrim substring substr left right concat concat_ws replace split_part "
    "row_number rank dense_rank percent_rank cume_dist ntile lag lead first_value last_value nth_value count sum avg min max bool_and bool_or every any count_if median percentile_cont percentile quantile_cont stddev stddev_pop stddev_samp variance var_pop var_samp approx_count_distinct "
    "max_by min_by arg_max arg_min array_agg collect_list listagg string_agg group_concat in between like isnull isnotnull not try_divide quarter".split()
)
#: Nodes that a read-only query consists of.
NODES = frozenset("Project Filter Join Aggregate Sort GlobalLimit LocalLimit Limit Offset Distinct Union Intersect Except SubqueryAlias UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedWith OneRowRelation UnresolvedHaving Window WithWindowDefinition UnresolvedInlineTable LocalRelation CTERelationDef CTERelationRef WithCTE".split())


class PolicyError(ValueError):
    pass


def _seq(jseq) -> list:
    return [jseq.apply(k) for k in range(jseq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _plans(plan):
    """A plan, its children and the plans of its sub-queries, with whether they stand inside an expression."""
    todo = [(plan, False)]
    while todo:
        p, inner = todo.pop()
        yield p, inner
        todo += [(x, inner) for x in _seq(p.children())]
        if _kind(p) == "UnresolvedWith":
            todo += [(r._2(), inner) for r in _seq(p.cteRelations())] if hasattr(_seq(p.cteRelations())[0], "_2") else []
        for e in _seq(p.expressions()):
            todo += [(x.plan(), True) for x in _expressions(e) if _kind(x) in ("ScalarSubquery", "Exists", "InSubquery", "ListQuery") and hasattr(x, "plan") and _kind(x) != "InSubquery"]


def _expressions(e):
    todo = [e]
    while todo:
        x = todo.pop()
        yield x
        todo += _seq(x.children())


def _statement(spark: SparkSession, sql: str, tables: set[str], subqueries: bool) -> None:
    if len(sql) > MAX_CHARS:
        raise PolicyError("the text is too long")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # the parser's own error, said in one line
        raise PolicyError("syntax: " + str(e).strip().splitlines()[0][:200]) from e
    ctes: set[str] = set()
    for p, _ in _plans(plan):
        if _kind(p) == "UnresolvedWith":
            ctes |= {str(r._1()).lower() for r in _seq(p.cteRelations())}
            if p.allowRecursion():
                raise PolicyError("recursive common table expressions are not allowed")
    for p, inner in _plans(plan):
        kind = _kind(p)
        if kind not in NODES:
            raise PolicyError(f"{kind} is not part of a read-only query")
        if inner and not subqueries:
            raise PolicyError("sub-queries in expressions are not allowed here")
        if kind == "UnresolvedRelation":
            parts = _seq(p.multipartIdentifier())
            name = str(parts[-1]).lower()
            if len(parts) > 1 or (name not in tables and name not in ctes):
                raise PolicyError(f"{'.'.join(map(str, parts))} is not an approved table")
        if kind == "Join":
            how = _kind(p.joinType())
            if how in ("UsingJoin", "NaturalJoin", "Cross") or "Natural" in how or "Using" in how or p.condition().isEmpty():
                raise PolicyError("every join needs its own ON condition")
        for e in _seq(p.expressions()):
            for x in _expressions(e):
                xk = _kind(x)
                if xk == "UnresolvedFunction":
                    parts = [str(n).lower() for n in _seq(x.nameParts())]
                    if len(parts) > 1 or parts[0] not in FUNCTIONS:
                        raise PolicyError(f"function {'.'.join(parts)} is not allowed")
                if xk == "UnresolvedStarExceptOrReplace" and x.replacements().isDefined():
                    raise PolicyError("only plain stars and exclusions are allowed")


class _Proof:
    """Origins of columns by identity, and the joins that follow approved relations."""

    def __init__(self, model: Model, views: set[str]):
        self.model, self.views, self.origin, self.defs, self.scans = model, views, {}, {}, 0

    def of(self, e):
        return self.origin.get(e.exprId().id()) if _kind(e) == "AttributeReference" else None

    def visit(self, p) -> None:
        kind = _kind(p)
        if kind == "SubqueryAlias" and str(p.alias()).lower() in self.views and _kind(p.child()) == "View":
            self.scans += 1
            for a in _seq(p.output()):
                self.origin[a.exprId().id()] = (self.scans, str(p.alias()).lower(), str(a.name()).lower())
            return
        if kind == "WithCTE":
            for d in _seq(p.cteDefs()):
                self.visit(d.child())
                self.defs[d.id()] = [self.of(a) for a in _seq(d.child().output())]
            self.visit(p.plan())
            return
        if kind == "CTERelationRef":
            self.scans += 1000
            for a, o in zip(_seq(p.output()), self.defs.get(p.cteId(), []), strict=False):
                if o:
                    self.origin[a.exprId().id()] = (self.scans + o[0], *o[1:])
            return
        for x in _seq(p.children()):
            self.visit(x)
        for e in _seq(p.expressions()):
            for x in _expressions(e):
                if _kind(x) in ("ScalarSubquery", "Exists"):
                    self.visit(x.plan())
                    self.correlated(x)
                    if _kind(x) == "ScalarSubquery":
                        self.one_value(x.plan())
                elif _kind(x) == "InSubquery":
                    self.visit(x.query().plan())
                    self.correlated(x.query())
                    self.member(x)
        if kind in ("Project", "Aggregate"):
            for e in _seq(p.projectList() if kind == "Project" else p.aggregateExpressions()):
                if _kind(e) == "Alias" and (o := self.of(e.child())):
                    self.origin[e.exprId().id()] = o
        elif kind in ("Union", "Intersect", "Except"):
            branches = [[self.of(a) for a in _seq(x.output())] for x in _seq(p.children())]
            for a, os in zip(_seq(p.output()), zip(*branches, strict=False), strict=False):
                if all(os) and len({o[1:] for o in os}) == 1:
                    self.origin[a.exprId().id()] = os[0]
                else:
                    self.origin.pop(a.exprId().id(), None)
        elif kind == "Join":
            self.join(p.condition().get())

    def correlated(self, x) -> None:
        """Outer references of a sub-query must meet the inner side along approved keys."""
        for p, _ in _plans(x.plan()):
            if _kind(p) == "Filter":
                for e in self.conjuncts(p.condition()):
                    if any(_kind(y) == "OuterReference" for y in _expressions(e)):
                        sides = [s.e() if _kind(s) == "OuterReference" else s for s in _seq(e.children())] if _kind(e) == "EqualTo" else []
                        if len(sides) != 2 or not self.equality(*map(self.of, sides)):
                            raise PolicyError("a correlated condition does not follow an approved relation")

    def member(self, x) -> None:
        """IN compares one column with one column: the same one, or the other end of an approved relation of one key."""
        values, inner = _seq(x.values()), _seq(x.query().plan().output())
        if len(values) != 1 or len(inner) != 1:
            raise PolicyError("IN takes one column")
        a, b = self.of(values[0]), self.of(inner[0])
        if not (a and b) or a[1:] != b[1:] and not self.equality(a, b):
            raise PolicyError("IN does not compare columns of one origin or of an approved relation")

    def one_value(self, p) -> None:
        """A scalar sub-query gives one row by its form: an aggregate of everything, or a limit of one."""
        while _kind(p) in ("Project", "SubqueryAlias", "Sort", "Filter", "WithCTE"):
            if _kind(p) == "Project" and any("Window" in _kind(y) for e in _seq(p.projectList()) for y in _expressions(e)):
                break
            p = p.plan() if _kind(p) == "WithCTE" else _seq(p.children())[0]
        single = _kind(p) == "Aggregate" and not _seq(p.groupingExpressions())
        limited = _kind(p) == "GlobalLimit" and _kind(p.limitExpr()) == "Literal" and int(p.limitExpr().value()) == 1
        if not (single or limited):
            raise PolicyError("a scalar sub-query must be one aggregate without groups, or end with LIMIT 1")

    def conjuncts(self, e) -> list:
        return [y for x in (e.left(), e.right()) for y in self.conjuncts(x)] if _kind(e) == "And" else [e]

    def equality(self, a, b) -> bool:
        """Whether one pair of origins is a whole approved relation by itself."""
        return bool(a and b) and any(not r.temporal and len(r.keys) == 1 and self.fits(r, {(a, b)}) for r in self.model.relations)

    def fits(self, r, pairs: set) -> bool:
        for left, right in ((r.left, r.right), (r.right, r.left)):
            want = {(left, x if left == r.left else y, right, y if left == r.left else x) for x, y in r.keys}
            for flip in (False, True):
                got = {((b, a) if flip else (a, b)) for a, b in pairs}
                if {(a[1], a[2], b[1], b[2]) for a, b in got} == want and len({(a[0], b[0]) for a, b in got}) == 1:
                    return True
        return False

    def bound(self, e):
        """(smaller, larger, strict) of a comparison of two columns with origins."""
        kind = _kind(e)
        if kind not in ("LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual"):
            return None
        a, b = self.of(e.left()), self.of(e.right())
        if not (a and b):
            return None
        return (a, b, kind == "LessThan") if kind.startswith("Less") else (b, a, kind == "GreaterThan")

    def join(self, condition) -> None:
        pairs, bounds, constants = set(), [], 0
        for e in self.conjuncts(condition):
            kind = _kind(e)
            if kind == "EqualTo" and self.of(e.left()) and self.of(e.right()):
                pairs.add((self.of(e.left()), self.of(e.right())))
            elif kind == "EqualTo" and sum(_kind(s) == "Literal" for s in (e.left(), e.right())) == 1 and sum(_kind(s) == "AttributeReference" for s in (e.left(), e.right())) == 1:
                constants += 1  # a constant on one side only narrows it
            elif self.bound(e):
                bounds.append((*self.bound(e), False))
            elif kind == "Or":
                sides = [e.left(), e.right()]
                null = [s for s in sides if _kind(s) == "IsNull"]
                rest = [s for s in sides if _kind(s) != "IsNull"]
                if len(null) != 1 or not (b := self.bound(rest[0])) or self.of(null[0].child()) != b[1]:
                    raise PolicyError("an OR in a join condition may only open an interval's end")
                bounds.append((*b, True))
            else:
                raise PolicyError("a join condition may only compare key columns")
        if not pairs and not bounds:
            raise PolicyError("a join needs approved keys")
        for r in self.model.relations:
            if not r.temporal and not bounds and self.fits(r, pairs):
                return
            if r.temporal and len(bounds) == 2 and (self.fits(r, pairs) if r.keys else not pairs):
                lower = [b for b in bounds if b[0][1:] == (r.right, r.start) and b[1][1:] == (r.left, r.point) and not b[2] and not b[3]]
                upper = [b for b in bounds if b[0][1:] == (r.left, r.point) and b[1][1:] == (r.right, r.end) and b[2] == (not r.end_inclusive) and b[3] == r.allow_open_end]
                if lower and upper and lower[0][0][0] == upper[0][1][0] and lower[0][1][0] == upper[0][0][0]:
                    return
        raise PolicyError("the join does not follow an approved relation")


_LEXEME = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*|\*/|.""", re.DOTALL)


def strip_comments(sql: str) -> str:
    """The text without comments, and so without hints; literals and quoted names stay as they are. Bracketed comments nest."""
    out, depth = [], 0
    for m in _LEXEME.finditer(sql):
        x = m[0]
        if x == "/*":
            depth += 1
        elif x == "*/" and depth:
            depth -= 1
            out.append(" " if not depth else "")
        elif not depth:
            out.append(" " if x.startswith("--") else x)
    return "".join(out)


def _literals_out(sql: str) -> str:
    return "".join(" " if m[0][0] in "'\"`" and len(m[0]) > 1 else m[0] for m in _LEXEME.finditer(sql))


def guarded_sql(spark: SparkSession, sql: str, model: Model, *, allowed: set[str] | None = None, subqueries: bool = False, parameters: dict | list | None = None) -> DataFrame:
    """The query's DataFrame, if every rule holds. Tables must be registered as temporary views of their names; parameters are bound, never pasted."""
    tables = {t.lower() for t in model.tables} & ({a.lower() for a in allowed} if allowed is not None else {t.lower() for t in model.tables})
    sql = strip_comments(sql)
    _statement(spark, sql, tables, subqueries)
    wanted = set(re.findall(r"(?<!:):([A-Za-z_]\w*)", _literals_out(sql)))
    if wanted != set(parameters if isinstance(parameters, dict) else ()):
        raise PolicyError(f"parameters {sorted(wanted ^ set(parameters or ()))} do not agree")
    places = _literals_out(sql).count("?")
    if places != (len(parameters) if isinstance(parameters, (list, tuple)) else 0):
        raise PolicyError(f"{places} places for parameters")
    df = spark.sql(sql, args=parameters) if parameters is not None else spark.sql(sql)
    names = [c.lower() for c in df.columns]
    if len(names) != len(set(names)):
        raise PolicyError("duplicate column names")
    _Proof(model, tables).visit(df._jdf.queryExecution().analyzed())
    return df


# What an error is called.
KINDS = [("timeout", "cancel|timeout|timed out"), ("policy", "^PolicyError "), ("aggregation", "GROUP_BY|AGGREGAT"), ("dialect", "PARSE_SYNTAX|syntax|UNRESOLVED_ROUTINE"), ("type", "DATATYPE|CAST_|TYPE_MISMATCH"), ("schema", "UNRESOLVED_COLUMN|TABLE_OR_VIEW|NOT_FOUND|AMBIGUOUS")]


def error_kind(e: Exception) -> str:
    text = f"{type(e).__name__} {e}"
    return next((k for k, p in KINDS if re.search(p, text)), "execution")


def with_timeout(spark: SparkSession, action, seconds: float):
    """Runs an action; a watchdog cancels its jobs, again and again until it ends, once the time is over."""
    if not 0 < seconds <= MAX_SECONDS:
        raise ValueError(f"a time-out lies between 0 and {MAX_SECONDS:g} seconds")
    tag, over, done = f"guard-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch():
        if not done.wait(seconds):
            over.set()
            while not done.wait(0.2):
                spark.sparkContext.cancelJobsWithTag(tag)

    spark.sparkContext.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    began = time.time()
    try:
        return action()
    except Exception as e:
        if over.is_set():
            raise TimeoutError(f"stopped after {time.time() - began:.1f} s") from e
        raise
    finally:
        done.set()
        spark.sparkContext.removeJobTag(tag)
        watcher.join()
