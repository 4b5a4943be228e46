"""H4: the registry of log types and their parsers.

A parser says which raw fields its messages carry and gives columns of the document as
expressions over them. All parsers of a registry become branches of one ``select``
(``parse.parse_documents``): another log type adds expressions to the one pass, never a scan,
a union or a Python call. ``PARSERS`` holds the built-in types; an application adds its own
to a copy and hands that to the ingest functions::

    mine = PARSERS.copy()
    mine.register_parser("proxy", "url string, bytes double", lambda raw: {
        "timestamp": raw("timestamp"), "event_name": F.lit("request"),
        "attributes": {"url": raw("url"), "bytes": raw("bytes").try_cast("bigint")}},
        ranges={"bytes": "bigint"}, id_fields=("url",))
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.envelope import RAW_SCHEMA

Raw = Callable[[str], Column]
TOP_LEVEL = ("timestamp", "log_attribute", "event_name")


@dataclass(frozen=True)
class Branch:
    """The columns that rows of some log types get from one function of their raw fields."""
    log_types: tuple[str, ...]
    columns: Callable[[Raw], dict]


@dataclass
class Parsers:
    branches: list[Branch] = field(default_factory=list)
    #: Raw fields beyond the built-in ones, and the integer types that numeric fields must fit.
    raw_fields: dict[str, T.DataType] = field(default_factory=dict)
    ranges: dict[str, str] = field(default_factory=dict)
    #: log type -> attributes that name its documents, beside source file and timestamp.
    id_fields: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def log_types(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(t for b in self.branches for t in b.log_types))

    def copy(self) -> Parsers:
        return Parsers(list(self.branches), dict(self.raw_fields), dict(self.ranges), dict(self.id_fields))

    def add(self, log_types: Iterable[str], columns: Callable[[Raw], dict]) -> None:
        """A branch shared by log types; a type may have several with different columns."""
        self.branches.append(Branch(tuple(log_types), columns))

    def register_parser(self, log_type: str, schema: str | T.StructType, function: Callable[[Raw], dict],
                        ranges: dict[str, str] | None = None, id_fields: Iterable[str] = ()) -> None:
        """Add the parser of a new ``log_type``.

        ``schema``: the raw fields it reads beyond the known ones, as DDL or a struct; a known name may be
        repeated with its own type. Numbers are best declared ``double``: NaN is cleaned, text in quotes is
        read. ``function(raw)`` gives ``timestamp``, ``log_attribute``, ``event_name`` (each optional) and
        ``attributes``, a dict of columns. ``ranges``: integer types of numeric fields; a message outside
        is a dead letter. ``id_fields``: attributes that, with source file and timestamp, make the id.
        """
        if not log_type or log_type in self.log_types:
            raise ValueError(f"the log type {log_type!r} is empty or has a parser already")
        struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        known = {f.name.lower(): f for f in self.raw_schema().fields}
        for f in struct.fields:
            if f.name.lower() in known and known[f.name.lower()].dataType != f.dataType:
                raise ValueError(f"raw field {f.name!r} is {known[f.name.lower()].dataType.simpleString()} elsewhere")
        unknown = set(ranges or {}) - {f.name for f in [*struct.fields, *self.raw_schema().fields]}
        if unknown:
            raise ValueError(f"ranges of fields that are not declared: {sorted(unknown)}")
        for f in struct.fields:
            if f.name.lower() not in known:
                self.raw_fields[f.name] = f.dataType
        for name, kind in (ranges or {}).items():
            if self.ranges.get(name, kind) != kind:
                raise ValueError(f"raw field {name!r} must fit {self.ranges[name]} elsewhere")
            self.ranges[name] = kind
        if id_fields:
            self.id_fields[log_type] = tuple(id_fields)
        self.add((log_type,), function)

    def raw_schema(self) -> T.StructType:
        return T.StructType([*RAW_SCHEMA.fields, *(T.StructField(n, t) for n, t in self.raw_fields.items())])

    def is_known(self) -> Column:
        return F.coalesce(F.col("log_type").isin(*self.log_types), F.lit(False))

    def document_columns(self) -> tuple[dict[str, Column], dict[str, Column]]:
        """(top-level columns, attributes): each a ``when`` over the branches that give it, null elsewhere."""
        raw: Raw = lambda name: F.col(f"raw.{name}")
        top: dict[str, Column] = {}
        attributes: dict[str, Column] = {}
        for b in self.branches:
            given = dict(b.columns(raw))
            cond = F.col("log_type").isin(*b.log_types) if len(b.log_types) > 1 else F.col("log_type") == b.log_types[0]
            wrong = set(given) - {*TOP_LEVEL, "attributes"}
            if wrong:
                raise ValueError(f"a parser of {b.log_types} gives unknown columns {sorted(wrong)}")
            parts = [(attributes, given.pop("attributes", {})), (top, given)]
            for into, columns in parts:
                for name, value in columns.items():
                    into[name] = into[name].when(cond, value) if name in into else F.when(cond, value)
        return top, attributes


def _long(c: Column) -> Column:
    return c.try_cast("bigint")


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _built_in() -> Parsers:
    p = Parsers(ranges={"DnsResponseCode": "int", "argsNum": "int", "eventId": "bigint", "returnValue": "bigint",
                        "processId": "bigint", "parentProcessId": "bigint", "userId": "bigint", "threadId": "bigint",
                        "mountNamespace": "bigint"})
    p.add(["dns"], lambda raw: {
        "timestamp": _text(raw("DnsTimestamp")), "log_attribute": F.lit("network_dns"),
        "attributes": {"source_ip": _text(raw("SourceIP")), "destination_ip": _text(raw("DestinationIP")),
                       "dns_query": _text(raw("DnsQuery")), "dns_response_code": _int(raw("DnsResponseCode"))}})
    kernel_and_host = ["deep_kernel", "standard_host"]
    p.add(kernel_and_host, lambda raw: {
        "timestamp": _text(raw("timestamp")),
        "attributes": {"host_name": _text(raw("hostName")), "event_id": _long(raw("eventId")),
                       "return_value": _long(raw("returnValue")), "process_id": _long(raw("processId")),
                       "parent_process_id": _long(raw("parentProcessId")), "process_name": _text(raw("processName")),
                       "user_id": _long(raw("userId"))}})
    p.add(["deep_kernel"], lambda raw: {
        "event_name": F.coalesce(raw("eventName"), F.lit("unknown_kernel_event")),
        "attributes": {"thread_id": _long(raw("threadId")), "mount_namespace": _long(raw("mountNamespace")),
                       "stack_addresses": _text(raw("stackAddresses"))}})
    p.add(["standard_host"], lambda raw: {"event_name": F.coalesce(raw("eventName"), F.lit("unknown_event"))})
    p.add(kernel_and_host, lambda raw: {"attributes": {"args_num": _int(raw("argsNum")), "args": raw("args")}})
    return p


#: The built-in log types.
PARSERS = _built_in()
