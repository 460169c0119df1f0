"""Declared schemas of the policy tables and facts."""

from __future__ import annotations

from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())
_MAP = T.MapType(T.StringType(), T.StringType())


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


USERS = _schema(
    user_id=T.StringType(), roles=_STRINGS, brand_scope=_STRINGS,
    clearance_rank=T.IntegerType(), metadata=_MAP)

AGENTS = _schema(
    agent_id=T.StringType(), agent_type=T.StringType(), ceiling_rank=T.IntegerType(),
    allowed_rights=_STRINGS, allowed_sources=_STRINGS)

ASSETS = _schema(
    asset_id=T.StringType(), name=T.StringType(), source=T.StringType(), table=T.StringType(),
    columns=_STRINGS, sensitivity_rank=T.IntegerType(), required_rights=_STRINGS,
    brand_tags=_STRINGS, brand_column=T.StringType(), row_filter_template=T.StringType(),
    pii_columns=_STRINGS, consent_required=T.BooleanType(), owner=T.StringType(), tags=_MAP)

CONSENT_EVENTS = _schema(
    subject_id=T.StringType(), asset_id=T.StringType(), granted=T.BooleanType(),
    ts=T.TimestampType(), seq=T.LongType())

ACCESS_REQUESTS = _schema(
    request_id=T.LongType(), ts=T.TimestampType(), session_id=T.StringType(),
    user_id=T.StringType(), agent_id=T.StringType(), asset_id=T.StringType(),
    access_right=T.StringType())

TOOL_CALLS = _schema(
    call_id=T.LongType(), ts=T.TimestampType(), tool=T.StringType(), source=T.StringType(),
    query=T.StringType(), agent_id=T.StringType(), token_id=T.StringType())

TOKEN_LEDGER = _schema(
    token_id=T.StringType(), query_hash=T.StringType(), query_preview=T.StringType(),
    user_id=T.StringType(), agent_id=T.StringType(), session_id=T.StringType(),
    policy_version=T.StringType(), issued_at=T.TimestampType(), expires_at=T.TimestampType(),
    row_filters=T.MapType(T.StringType(), T.StringType()), masked_columns=_STRINGS,
    asset_ids=_STRINGS)

REVOCATIONS = _schema(kind=T.StringType(), id=T.StringType(), ts=T.TimestampType())

AGENT_OUTPUTS = _schema(
    session_id=T.StringType(), agent_id=T.StringType(), output_type=T.StringType(),
    out_seq=T.LongType(), row_seq=T.LongType(), data=_MAP, sensitivity_rank=T.IntegerType(),
    produced_at=T.TimestampType())

CONTEXT_REQUESTS = _schema(
    request_id=T.LongType(), session_id=T.StringType(), requesting_agent_id=T.StringType(),
    needed_types=_STRINGS, needed_fields=T.MapType(T.StringType(), _STRINGS),
    ceiling_rank=T.IntegerType(), ts=T.TimestampType())

CACHE_WRITES = _schema(
    write_id=T.LongType(), ts=T.TimestampType(), user_id=T.StringType(), agent_id=T.StringType(),
    query=T.StringType(), policy_version=T.StringType(), sensitivity_rank=T.IntegerType(),
    payload=T.BinaryType())

CLAIMS = _schema(
    claim_id=T.LongType(), oid=T.StringType(), sub=T.StringType(), upn=T.StringType(),
    preferred_username=T.StringType(), name=T.StringType(), tid=T.StringType(),
    groups=_STRINGS, roles=_STRINGS, scp=T.StringType(), azp=T.StringType(),
    appid=T.StringType(), idtyp=T.StringType(), aud=T.StringType(), iss=T.StringType(),
    exp=T.LongType(), iat=T.LongType(), overage=T.BooleanType())
