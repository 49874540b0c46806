"""Formulas in answers: equality, and the rewards that recipes make of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import formulas
from lodestone.plans.registry import query

#: (answer, gold, whether they are equal; None: the gold text is no formula). A k stands for a number of each document's own.
FORMS = [
    (r"\frac{k}{2}", "k/2", True), (r"\dfrac{k}{4}", "k/2", False), ("2(x+k)", "2x+2*k", True), ("(x+k)^2", "x^2+2*kx+k^2", True), ("(x-k)^2", "x^2+k^2", False),
    (r"\sqrt{k}\sqrt{k}", "k", True), (r"\frac{1}{\sqrt{k}}", r"\frac{\sqrt{k}}{k}", True), ("x=k", "k", True), ("x=k", "k+1", False), ("k,000", "k000", True),
    (r"\frac{x^2-k^2}{x-k}", "x+k", True), (r"\left(1, \frac{2*k}{2}\right)", "(1,k)", True), ("(1,k)", "(k,1)", False), (r"\{1,k\}", r"\{k,1\}", True), ("[0,k)", "(0,k)", False),
    (r"1\pm\sqrt{k}", r"1-\sqrt{k}, 1+\sqrt{k}", True), (r"k\%", "k/100", True), (r"k^\circ", "k", True), (r"k\text{ cm}", "k", True), ("(1+ki)^2", "1-k^2+2*ki", True),
    (r"\sin(kx)", r"\cos(kx)", False), ("x<k", "k>x", True), ("x<k", "x>k", False), ("x+y=k", "2x+2y=2*k", True), (r"\sqrt[3]{k^3}", "k", True),
    (r"2\frac{1}{k}", "(2*k+1)/k", True), ("", "k", False), ("k", "no number k here @", None), (r"\pi k", "3.14*k", False), ("k/(x-x)", "k", False),
]
_REWARDS = ", ".join("-1.0" if not a else "NULL" if e is None else "1.0" if e else "0.0" for a, _, e in FORMS)


@query(f"""SELECT doc_id, coalesce(r, 1.0) AS skipping, coalesce(r, 0.0) AS failing, r IS NOT NULL AS gold_parsed FROM (SELECT doc_id, ([{_REWARDS}])[doc_id % {len(FORMS)} + 1] AS r FROM documents)""")
def formula_rewards(t):
    """Answers that each document's number is put into, so no two batches have the same formulas."""
    form = F.get(F.array(*(F.array(F.lit(a), F.lit(g)) for a, g, _ in FORMS)), (F.col("doc_id") % len(FORMS)).cast("int"))
    k = (F.col("doc_id") % 991 + 12).cast("string")
    filled = lambda c: F.regexp_replace(c, F.lit("k"), k)
    rows = t.documents.select("doc_id", form.alias("form")).select("doc_id", filled(F.col("form")[0]).alias("answer"), filled(F.col("form")[1]).alias("gold"))
    reward = lambda bad: formulas.formula_reward(F.col("answer"), F.col("gold"), bad)
    return rows.select("doc_id", reward(1.0).alias("skipping"), reward(0.0).alias("failing"), formulas.is_formula("gold").alias("gold_parsed"))
