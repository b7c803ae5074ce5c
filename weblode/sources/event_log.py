"""The event log on the wire (flat maps of strings) and as typed rows."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from weblode.schema import DISCARD_REASONS, EVENT, EVENT_TYPES, URL_STATUSES

EVENT_TAIL_BATCH = 100


def _to_text(field: T.StructField) -> Column:
    column, kind = F.col(field.name), field.dataType
    if isinstance(kind, T.StringType):
        return column
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.to_json(column, {"ignoreNullFields": "true"})
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return column.cast("string")


def encode_events(events: DataFrame, out: str = "data", keep=()) -> DataFrame:
    """Typed events to flat maps: NULL fields left out, nested values as JSON."""
    known = {f.name for f in EVENT}
    pairs = [x for f in events.schema if f.name in known for x in (F.lit(f.name), _to_text(f))]
    return events.select(*keep, F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias(out))


def _typed(field: T.StructField, text: Column) -> Column:
    kind = field.dataType
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.StructType):
        return F.from_json(text, kind, {"mode": "PERMISSIVE"})
    if isinstance(kind, T.MapType):  # any value may stand in a map; what is no number is NULL
        return F.transform_values(F.from_json(text, "map<string,string>"), lambda _, v: v.try_cast("double"))
    return text.try_cast(kind)


def _unreadable(field: T.StructField, text: Column, typed: Column) -> Column:
    """The text cannot be read as the type. A struct of nulls does not tell, so JSON is looked at as such."""
    if isinstance(field.dataType, T.StructType):
        return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False)) == F.lit(False)
    return typed.isNull()


def decode_events(raw: DataFrame, data: str = "data", keep=()) -> DataFrame:
    """Flat maps to typed events plus ``error``: NULL for a valid event, else what is wrong with it.

    A text field stays text whatever it looks like. An event with a value that does not fit, an
    unknown type, status or reason, or without type or job is kept and named in ``error``.

    One projection: typing a field and checking it are the same expression, which generated code works out once.
    """
    text = lambda name: F.col(data)[name]
    typed = {f.name: _typed(f, text(f.name)) for f in EVENT}
    wrong = [(text(name).isNull(), f"{name} missing") for name in ("event_type", "job_id")]
    for name, allowed in {"event_type": EVENT_TYPES, "status": URL_STATUSES, "discard_reason": DISCARD_REASONS}.items():
        wrong.append((~text(name).isin(*allowed), f"{name} unknown"))
    for field in EVENT:
        if not isinstance(field.dataType, T.StringType):
            wrong.append((text(field.name).isNotNull() & _unreadable(field, text(field.name), typed[field.name]), f"{field.name} malformed"))
    error = None
    for condition, what in wrong:
        error = F.when(condition, what) if error is None else error.when(condition, what)
    return raw.select(*keep, *[typed[f.name].alias(f.name) for f in EVENT], error.alias("error"))


def as_log(decoded: DataFrame, seq: str = "seq") -> DataFrame:
    """Decoded events in the form the folds take: ``ts``, ``seq`` (place in the stream) and ``discard_stage``.

    The wire does not say at which stage a URL was discarded, the fields do: only what a fetch task refuses carries a domain
    without being a duplicate; a link refused by a rule has none, a duplicate link has that of its target.
    """
    link = (F.col("discard_reason") == "duplicate") | F.col("domain").isNull()
    stage = F.when(F.col("event_type") == "url_discarded", F.when(link, "link").otherwise("fetch"))
    names = [c for c in decoded.columns if c not in ("timestamp", seq, "error")]
    return decoded.select(F.col(seq).alias("seq"), F.col("timestamp").alias("ts"), *names, stage.alias("discard_stage"))


def valid_events(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("error").isNull()).drop("error")


def invalid_events(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("error").isNotNull())


def start_encoded(events: DataFrame, path: str, keep=("seq",), once: bool = True):
    """Write a stream of events in wire form, each micro-batch to a folder of its own (see ``sink.start``)."""
    from weblode.streaming import sink
    return sink.start(encode_events(events, keep=keep), path, once=once)


def tail_events(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet",
                fmt: str = "parquet", files_per_batch: int = EVENT_TAIL_BATCH) -> DataFrame:
    """Follow an event log that grows by files; position and state live in the query's checkpoint."""
    return (
        spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", pattern).load(folder)
    )
