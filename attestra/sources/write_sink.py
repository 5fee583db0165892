"""What review has settled is written into a host tool, each item once.

A stream's micro-batches go through a ledger of idempotency keys. A batch is named by its stream and number, so that the same batch run twice is known as such; its keys are noted in the ledger last, in one step, and only that makes them count as written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.operators.review import enveloped
from attestra.sources.folders import Files

#: Each row handed to a write: whose it is, the values, where they go, and the key that makes a repeated write harmless.
KEY = "idempotency_key"


@dataclass(frozen=True)
class Adapter:
    """What a host tool takes: values of a schema, a context that says where they go, and a write.

    write gets a DataFrame of id, fields, context and idempotency_key and the name of its batch, and writes it whole or fails. After a failure it may get rows again that it has written, with the same keys and in a batch of the same name: it must write them over, or leave what it knows.
    """

    name: str
    schema: T.StructType
    context: T.StructType
    write: Callable[[DataFrame, str], None]
    required_on_create: tuple[str, ...] = ()
    instructions: str = ""
    examples: tuple[dict, ...] = field(default=())

    def __post_init__(self):
        unknown = [p for p in self.required_on_create if p not in value_paths(self.schema)]
        if unknown:
            raise ValueError(f"{self.name}: no such fields: {', '.join(unknown)}")

    def extraction_schema(self) -> T.StructType:
        """What a model must produce: every leaf of the schema in an envelope."""
        return enveloped(self.schema)

    def checked(self, items: DataFrame, fields: str = "fields", context: str = "context") -> DataFrame:
        """items with fields and context, JSON texts, parsed, and problem: why an item can never be written, or null. The context is looked at first: what is wrong with it no review can mend."""
        others = [x for x in items.columns if x not in (fields, context)]
        parsed = items.select(*others, _parsed(F.col(context), self.context).alias("context__"), _parsed(F.col(fields), self.schema).alias("fields__"))
        c, f = F.col("context__"), F.col("fields__")
        lacking = F.filter(F.array(*map(F.lit, self.context.names)), lambda k: ~F.array_contains(c["there"], k))
        needed = F.filter(F.array(*map(F.lit, [p.split(".")[0] for p in self.required_on_create])).cast("array<string>"), lambda k: ~F.array_contains(f["there"], k))
        told = lambda what, names: F.concat(F.lit(what), F.array_join(names, ", "))
        problem = (
            F.when(~c["object"], "context is no object").when(F.size(c["wrong"]) > 0, told("context has wrong ", c["wrong"])).when(F.size(lacking) > 0, told("context lacks ", lacking))
            .when(~f["object"], "fields are no object").when(F.size(f["there"]) == 0, "nothing to write").when(F.size(f["odd"]) > 0, told("unknown fields ", f["odd"])).when(F.size(f["wrong"]) > 0, told("wrong fields ", f["wrong"]))
            .when(F.size(needed) > 0, told("fields lack ", needed))
        )
        return parsed.select(*others, c["value"].alias(context), f["value"].alias(fields), problem.alias("problem"))


def value_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted paths of a schema's leaves."""
    return [p for f in schema for p in (value_paths(f.dataType, f"{prefix}{f.name}.") if isinstance(f.dataType, T.StructType) else [prefix + f.name])]


def _parsed(json: Column, schema: T.StructType) -> Column:
    """value by the schema, and of the object's names: there, odd (none of the schema's) and wrong (of another kind than the schema says; null fits all)."""
    node, names = F.try_parse_json(json), F.coalesce(F.json_object_keys(json), F.expr("CAST(array() AS array<string>)"))
    value = F.from_json(json, schema)
    kind = lambda n: F.schema_of_variant(F.variant_get(node, f"$.{n}", "variant"))
    wrong = F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(~F.coalesce(kind(f.name) == "VOID", F.lit(True)) & ~F.regexp_like(kind(f.name), F.lit(_KINDS.get(f.dataType.typeName(), "."))), f.name) for f in schema)))
    return F.struct(
        value.alias("value"), F.coalesce(F.json_object_keys(json).isNotNull() & node.isNotNull(), F.lit(False)).alias("object"), names.alias("there"),
        F.array_except(names, F.array(*map(F.lit, schema.names)).cast("array<string>")).alias("odd"), wrong.alias("wrong"),
    )


#: The kinds of JSON that fit a type, as Spark names them.
_KINDS = {"string": "^STRING", "long": "^BIGINT", "integer": "^BIGINT", "double": "^(BIGINT|DECIMAL|DOUBLE)", "boolean": "^BOOLEAN", "struct": "^OBJECT", "array": "^ARRAY"}


class WriteSink:
    """root: a folder that driver and executors share. It holds ledger (the keys of each batch that has been written) and refused (items that can never be written, and why)."""

    def __init__(self, spark: SparkSession, root: str, adapter: Adapter, after_write: Callable[[str], None] | None = None):
        """after_write: called with a batch's name between its write and its entry in the ledger; what it raises stops the stream there."""
        self.spark, self.root, self.adapter, self._after_write = spark, root, adapter, after_write

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        return self.spark.read.schema(schema + ", batch string").option("basePath", path).parquet(path) if Files(self.spark).exists(path) else self.spark.createDataFrame([], schema + ", batch string")

    def ledger(self) -> DataFrame:
        """idempotency_key and batch of everything that has been written."""
        return self._table("ledger", f"{KEY} string")

    def refused(self) -> DataFrame:
        return self._table("refused", "id string, problem string")

    def _entered(self, batch: str) -> bool:
        return Files(self.spark).exists(f"{self.root}/ledger/batch={batch}/_SUCCESS")

    def write(self, rows: DataFrame, batch: str) -> None:
        """One batch of id, fields and context (JSON texts) and idempotency_key. A batch that is in the ledger is done with; keys of other batches are left out, and of rows with one key that of least id is written."""
        if self._entered(batch):
            return
        rows = self.adapter.checked(rows)
        rows.where("problem IS NOT NULL").select(F.col("id").cast("string").alias("id"), "problem").write.mode("overwrite").parquet(f"{self.root}/refused/batch={batch}")
        fit = rows.where("problem IS NULL").groupBy(KEY).agg(F.min_by(F.struct("id", "fields", "context"), "id").alias("row")).select(KEY, "row.*")
        done = self.ledger().where(F.col("batch") != batch).select(KEY)
        fresh = fit.join(done, KEY, "left_anti").select("id", "fields", "context", KEY)
        # a copy in the shared folder: the tool and the ledger get the same rows whatever is lost in between
        fresh.write.mode("overwrite").parquet(f"{self.root}/staged/batch={batch}")
        staged = self.spark.read.schema(fresh.schema).parquet(f"{self.root}/staged/batch={batch}")
        self.adapter.write(staged, batch)
        if self._after_write:
            self._after_write(batch)
        staged.select(F.col(KEY).cast("string").alias(KEY)).write.mode("overwrite").parquet(f"{self.root}/ledger/batch={batch}")
        Files(self.spark).delete(f"{self.root}/staged/batch={batch}")

    def start(self, stream: DataFrame, checkpoint: str):
        """The stream's batches, all that is there now, through the sink; its checkpoint tells after a failure where to go on."""

        def run(rows: DataFrame, epoch: int) -> None:
            query = self.spark.sparkContext.getLocalProperty("sql.streaming.queryId")
            self.write(rows, f"{query}-{epoch:012d}")

        return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folder_writer(root: str) -> Callable[[DataFrame, str], None]:
    """A write into a folder of Parquet, for tools that take files: a batch's folder is written over, so that a batch that comes twice is there once."""

    def write(rows: DataFrame, batch: str) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/batch={batch}")

    return write


def tool_rows(sink: WriteSink, root: str, schema: T.StructType) -> DataFrame:
    """What folder_writer() has put in a folder, but for batches that have not come to the ledger."""
    rows = sink.spark.read.schema(schema.add("batch", "string")).option("basePath", root).parquet(root)
    return rows.join(sink.ledger().select(F.col(KEY).alias("key__"), F.col("batch").alias("batch__")), (F.col(KEY) == F.col("key__")) & (F.col("batch") == F.col("batch__")), "left_semi").drop("batch")
