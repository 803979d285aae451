"""The few spellings in which Spark SQL and DuckDB differ, so that a plan is stated once for both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from condensa.functions.text import METRIC, TOKEN  # noqa: F401
from condensa.sources.tables import read_table

TABLES = ("documents", "benchmark", "labels", "conversations", "pages", "orders", "lineitem", "events", "customer")

class SparkSQL:
    def t(self, name: str) -> str:
        return f"condensa_{name}"

    def quote(self, s: str) -> str:
        return "r'" + s + "'" if "'" not in s else 'r"' + s + '"'

    def find_all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.quote(pattern)}, 1)"

    def find(self, x: str, pattern: str) -> str:
        return f"regexp_extract({x}, {self.quote(pattern)}, 1)"

    def like(self, x: str, pattern: str) -> str:
        return f"({x} rlike {self.quote(pattern)})"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.quote(pattern)}, {self.quote(by.replace('#', '$'))})"

    def size(self, a: str) -> str:
        return f"size({a})"

    def split(self, x: str, by: str) -> str:
        return f"split({x}, {self.quote(by)})"

    def join(self, a: str, by: str = " ") -> str:
        return f"array_join({a}, '{by}')"

    def at(self, a: str, i: str) -> str:
        return f"get({a}, ({i}) - 1)"

    def grams(self, a: str, n: int) -> str:
        return f"case when size({a}) >= {n} then transform(sequence(1, size({a}) - {n - 1}), i -> array_join(slice({a}, i, {n}), ' ')) else array() end"

    def explode(self, sub: str, a: str, pos: str = "pos", val: str = "val") -> str:
        """Rows of sub with a position from 1 and a value each. Outer, then filtered: an inner explosion
        makes the optimiser test the array's size on a second copy of the expression that builds it."""
        return f"(select * from (select t.*, {pos}_0 + 1 as {pos}, {val} from ({sub}) t lateral view outer posexplode(t.{a}) u as {pos}_0, {val}) where {pos} is not null)"

    def md5_int(self, x: str) -> str:
        return f"cast(conv(substr(md5({x}), 1, 8), 16, 10) as bigint)"

    def half_even(self, x: str) -> str:
        return f"cast(bround({x}, 0) as bigint)"

    def percentile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def struct(self, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def range(self, lo: str, hi: str) -> str:
        return f"(select {self.each(lo, hi)} as i)"

    def each(self, lo: str, hi: str) -> str:
        """A row for each whole number from lo to hi, of each row selected from."""
        return f"explode(sequence(cast({lo} as bigint), cast({hi} as bigint)))"

    def json(self, x: str, field: str) -> str:
        return f"get_json_object({x}, '$.{field}')"


class DuckSQL(SparkSQL):
    def t(self, name: str) -> str:
        return name

    def quote(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def find(self, x: str, pattern: str) -> str:
        return f"regexp_extract({x}, {self.quote(pattern)}, 1)"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.quote(pattern)})"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.quote(pattern)}, {self.quote(by.replace('#', chr(92)))}, 'g')"

    def size(self, a: str) -> str:
        return f"len({a})"

    def split(self, x: str, by: str) -> str:
        return f"string_split_regex({x}, {self.quote(by)})"

    def join(self, a: str, by: str = " ") -> str:
        return f"array_to_string({a}, '{by}')"

    def at(self, a: str, i: str) -> str:
        return f"{a}[{i}]"

    def grams(self, a: str, n: int) -> str:
        return f"list_transform(range(1, len({a}) - {n - 2}), lambda i: array_to_string({a}[i:i + {n - 1}], ' '))"

    def explode(self, sub: str, a: str, pos: str = "pos", val: str = "val") -> str:
        return f"(select t.*, unnest(range(1, len(t.{a}) + 1)) as {pos}, unnest(t.{a}) as {val} from ({sub}) t)"

    def md5_int(self, x: str) -> str:
        return f"cast(concat('0x', substr(md5({x}), 1, 8)) as bigint)"

    def half_even(self, x: str) -> str:
        return f"cast(round_even({x}, 0) as bigint)"

    def percentile(self, x: str, p: float) -> str:
        return f"quantile_cont({x}, {p})"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def struct(self, **fields: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def range(self, lo: str, hi: str) -> str:
        return f"(select {self.each(lo, hi)} as i)"

    def each(self, lo: str, hi: str) -> str:
        return f"unnest(range(cast({lo} as bigint), cast({hi} as bigint) + 1))"

    def json(self, x: str, field: str) -> str:
        return f"json_extract_string({x}, '$.{field}')"


SPARK, DUCK = SparkSQL(), DuckSQL()


def runner(plan: Callable[[SparkSQL], str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = plan(SPARK)
        for name in TABLES:
            if SPARK.t(name) in text:
                read_table(spark, sf_dir, name).createOrReplaceTempView(SPARK.t(name))
        return spark.sql(text)

    return run
