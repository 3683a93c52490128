"""SQL statements whose joins by a spatial predicate run as cell joins.

A statement is analysed by Spark. Where a join's condition, or the filter right over a join, holds a predicate by its SQL name
of one argument from either side, the join becomes a `cell_join`: both arguments are columns of their sides, tiles their boxes,
and other conditions are filters over it. Columns keep their identities, so what stands above the join stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.classic.column import Column as ClassicColumn

from terracell.functions import predicates, tiles
from terracell.operators.join import cell_join

#: SQL name of each predicate.
NAMES = {"st_intersects": "intersects", "st_contains": "contains", "st_containedby": "containedby"}
#: Join types of Spark, and what `cell_join` calls them.
HOW = {"Inner": "inner", "Cross": "inner", "LeftOuter": "left", "LeftSemi": "left_semi", "LeftAnti": "left_anti"}


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _conjuncts(e) -> list:
    return [*_conjuncts(e.left()), *_conjuncts(e.right())] if _kind(e) == "And" else [e]


class _Rewriter:
    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.jvm, self.joins = spark, spark._jvm, 0

    def column(self, e) -> Column:
        return ClassicColumn(self.jvm.org.apache.spark.sql.classic.ExpressionUtils.column(e))

    def frame(self, plan) -> DataFrame:
        return DataFrame(self.jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan), self.spark)

    def value(self, e) -> Column:
        c = self.column(e)
        return tiles.st_geomfromtile(c) if e.dataType().simpleString().startswith("struct<ulx") else c

    def seq(self, items: list):
        held = self.jvm.java.util.ArrayList()
        for x in items:
            held.add(x)
        return self.jvm.scala.jdk.javaapi.CollectionConverters.asScala(held).toSeq()

    def sides(self, e, left, right) -> bool | None:
        """Whether the predicate's first argument is the left side's; None if the arguments don't come from one side each."""
        if _kind(e) != "PythonUDF" or e.name().lower() not in NAMES:
            return None
        a, b = (x.references() for x in _items(e.children()))
        if not a.size() or not b.size():
            return None
        l, r = left.outputSet(), right.outputSet()
        return True if a.subsetOf(l) and b.subsetOf(r) else False if a.subsetOf(r) and b.subsetOf(l) else None

    def joined(self, join, more: list):
        """The plan of a join with further conditions from a filter over it, or None where no predicate leads it."""
        how = HOW.get(join.joinType().toString())
        left, right = join.left(), join.right()
        own = _conjuncts(join.condition().get()) if join.condition().isDefined() else []
        every = own + more if how == "inner" else own
        leads = [e for e in every if self.sides(e, left, right) is not None]
        if how is None or not leads or how != "inner" and (len(own) > 1 or more):
            return None
        lead = leads[0]
        a, b = _items(lead.children())
        name = NAMES[lead.name().lower()]
        if not self.sides(lead, left, right):
            a, b, name = b, a, predicates.FLIPPED[name]
        rest = [e for e in every if e is not lead]
        lo, ro = _items(left.output()), _items(right.output())
        # names of their own on both sides; rows without a value can have no partner
        x = self.frame(left).select(*[self.column(c).alias(f"_l{i}") for i, c in enumerate(lo)], self.value(a).alias("_lst"))
        y = self.frame(right).select(*[self.column(c).alias(f"_r{i}") for i, c in enumerate(ro)], self.value(b).alias("_rst"))
        pairs = cell_join(x, y, lambda p, q: predicates.predicate(name, p, q, "any"), how, "_lst", "_rst")
        self.joins += 1
        kept = [(c, f"_l{i}") for i, c in enumerate(lo)] + ([(c, f"_r{i}") for i, c in enumerate(ro)] if how in ("inner", "left") else [])
        plan = pairs.select(*[n for _, n in kept])._jdf.queryExecution().analyzed()
        alias = self.jvm.org.apache.spark.sql.catalyst.expressions.Alias
        none = self.jvm.scala.Option.empty()
        out = [alias(new, c.name(), c.exprId(), c.qualifier(), none, self.seq([])) for (c, _), new in zip(kept, _items(plan.output()))]
        plan = self.jvm.org.apache.spark.sql.catalyst.plans.logical.Project(self.seq(out), plan)
        for e in rest:
            plan = self.jvm.org.apache.spark.sql.catalyst.plans.logical.Filter(e, plan)
        return plan

    def plan(self, node):
        kids = _items(node.children())
        if _kind(node) == "Filter" and _kind(kids[0]) == "Join":
            below = kids[0].withNewChildren(self.seq([self.plan(k) for k in _items(kids[0].children())]))
            made = self.joined(below, _conjuncts(node.condition()))
            return made or node.withNewChildren(self.seq([self.joined(below, []) or below]))
        if kids:
            node = node.withNewChildren(self.seq([self.plan(k) for k in kids]))
        return (self.joined(node, []) or node) if _kind(node) == "Join" else node


def spatial_sql(spark: SparkSession, statement: str) -> DataFrame:
    """Rows of a SELECT statement. The functions must be registered (`functions.sql.register`).

    Inner joins may have further conditions; outer, semi and anti joins are rewritten where the predicate is their only
    one. Other joins, and predicates inside of OR, run as Spark plans them.
    """
    plan = spark.sql(statement)._jdf.queryExecution().analyzed()
    rewriter = _Rewriter(spark)
    made = rewriter.plan(plan)
    return rewriter.frame(made) if rewriter.joins else rewriter.frame(plan)


