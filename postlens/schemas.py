"""Table schemas."""

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _schema(**fields):
    return StructType([StructField(name, dtype, True) for name, dtype in fields.items()])


MESSAGE = _schema(msg_id=LongType(), text=StringType(), label=IntegerType(), source=StringType())
PAIR = _schema(
    pair_id=LongType(), text=StringType(), summary=StringType(), topic=StringType(), source=StringType()
)
RECORD = _schema(
    id=StringType(),
    tenant_id=StringType(),
    domain=StringType(),
    split=StringType(),
    text=StringType(),
    label=IntegerType(),
    summary=StringType(),
    source=StringType(),
    metadata=MapType(StringType(), StringType()),
    created_at=TimestampType(),
)
DATASET_VERSION = _schema(
    version=StringType(),
    domain=StringType(),
    train_count=LongType(),
    val_count=LongType(),
    test_count=LongType(),
    created_at=TimestampType(),
    description=StringType(),
)
POLICY = _schema(
    tenant_id=StringType(),
    spam_threshold=DoubleType(),
    phishing_threshold=DoubleType(),
    min_confidence=DoubleType(),
    preferred_model=StringType(),
)
FEEDBACK = _schema(
    tenant_id=StringType(),
    message_id=StringType(),
    feedback=StringType(),
    attributes=MapType(StringType(), StringType()),
    created_at=TimestampType(),
)
RUN = _schema(
    task=StringType(),
    run_id=StringType(),
    at=TimestampType(),
    precision=DoubleType(),
    recall=DoubleType(),
    f1=DoubleType(),
    promoted=BooleanType(),
    failure_reason=StringType(),
)
