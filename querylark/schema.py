"""Fields, their types and what a schema allows. Everything here runs on the driver over a few names; data stays in Spark."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import types as T

TEXT, STRING, I64, U64, F64, DATE, BOOLEAN, BYTES, IP, JSON, FACET = "text string i64 u64 f64 date boolean bytes ip json facet".split()
ALIASES = {TEXT: "", STRING: "exact", I64: "integer int number numeric signed", U64: "unsigned uint", F64: "float double decimal", DATE: "datetime timestamp", BOOLEAN: "bool", BYTES: "binary blob", IP: "", JSON: "object document", FACET: "category tag"}
TYPE_OF = {name: t for t, more in ALIASES.items() for name in (t, *more.split())}
NUMERIC = (I64, U64, F64)
MEASURABLE = (*NUMERIC, DATE)
BARE = (TEXT, STRING, JSON)
RANGED = (TEXT, STRING, *NUMERIC, DATE, IP)
SPARK = {TEXT: T.StringType(), STRING: T.StringType(), I64: T.LongType(), U64: T.DecimalType(20, 0), F64: T.DoubleType(), DATE: T.TimestampType(), BOOLEAN: T.BooleanType(), BYTES: T.BinaryType(), IP: T.StringType(), JSON: T.StringType(), FACET: T.StringType()}
MAX_DESCRIPTION, MAX_FIELD_DESCRIPTION, MAX_DEFAULT_FIELDS = 512, 200, 64


class SchemaError(ValueError):
    """A declaration that no index can have."""


@dataclass(frozen=True)
class Ghost:
    """A search column fed from another field, always or when a discriminating field's value is (not) among some."""

    source: str
    when: str | None = None
    within: tuple[str, ...] | None = None
    outside: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    indexed: bool = True
    many: bool = False
    fast: bool | None = None
    shadow: bool = False
    tokenizer: str = "default"
    positions: bool = True
    ghost: Ghost | None = None
    description: str = ""
    learned: bool = False

    @property
    def is_fast(self) -> bool:
        return self.type in MEASURABLE if self.fast is None else self.fast

    @property
    def sortable(self) -> bool:
        return self.ghost is None and self.type not in (BOOLEAN, BYTES, JSON, FACET) and (self.is_fast or self.type in (TEXT, STRING) or self.shadow)


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]
    default_fields: tuple[str, ...] = ()
    id_fields: tuple[str, ...] = ()
    routing: str | None = None
    description: str = ""
    version: int = 1
    _by_name: dict = field(default=None, compare=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "_by_name", {f.name: f for f in self.fields})

    def get(self, name: str) -> Field | None:
        return self._by_name.get(name)

    @property
    def shadow(self) -> Field | None:
        return next((f for f in self.fields if f.shadow), None)

    def searched_by_default(self, most: int = MAX_DEFAULT_FIELDS) -> tuple[list[str], bool]:
        """Fields that a bare term reaches, in declared order or else by name, and whether `most` cut the list."""
        able = [f.name for f in self.fields if f.indexed and f.type in BARE and f.name != "id" and not f.shadow]
        named = [n for n in self.default_fields if n in able] if self.default_fields else sorted(able)
        return named[:most], len(named) > most

    def validate(self, tokenizers: Iterable[str]) -> Schema:
        known, names = set(tokenizers), [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise SchemaError("a field is declared twice")
        if len(self.description) > MAX_DESCRIPTION:
            raise SchemaError(f"the description is longer than {MAX_DESCRIPTION} characters")
        if sum(f.shadow for f in self.fields) > 1:
            raise SchemaError("only one field can stand for the id")
        for f in self.fields:
            if f.type not in SPARK:
                raise SchemaError(f"field '{f.name}': no type '{f.type}'")
            if f.tokenizer not in known:
                raise SchemaError(f"field '{f.name}': no tokenizer '{f.tokenizer}'")
            if f.tokenizer != "default" and f.type != TEXT:
                raise SchemaError(f"field '{f.name}': only text takes a tokenizer")
            if len(f.description) > MAX_FIELD_DESCRIPTION:
                raise SchemaError(f"field '{f.name}': the description is longer than {MAX_FIELD_DESCRIPTION} characters")
            if f.ghost:
                source = self.get(f.ghost.source)
                if f.type != TEXT or source is None or source.type not in (TEXT, STRING) or source.ghost:
                    raise SchemaError(f"field '{f.name}': a ghost is text and takes its text from a stored text or string field")
                if f.ghost.when and self.get(f.ghost.when) is None:
                    raise SchemaError(f"field '{f.name}': no field '{f.ghost.when}'")
                if f.ghost.when and (f.ghost.within is None) == (f.ghost.outside is None):
                    raise SchemaError(f"field '{f.name}': either the values within or those outside are named")
        for n in self.default_fields:
            f = self.get(n)
            if f is None or not f.indexed or f.type not in BARE:
                raise SchemaError(f"default field '{n}' is not a searchable text, string or json field")
        return self

    def thumbprint(self) -> str:
        """Hash of what the schema means: the order of fields and the version don't count."""
        parts = sorted((asdict(f) for f in self.fields), key=lambda f: f["name"])
        text = json.dumps({"fields": parts, "default": self.default_fields, "id": self.id_fields, "routing": self.routing}, sort_keys=True, default=list)
        return hashlib.sha256(text.encode()).hexdigest()[:16]

    def learn(self, more: Schema) -> Schema:
        """This schema and the fields that a later write brought: new ones are learned, not searchable; learned ones widen."""
        out, changed = [], False
        for f in self.fields:
            g = more.get(f.name)
            if g is not None and f.learned and g.type != f.type:
                f, changed = replace(f, type=widen(f.type, g.type)), True
            out.append(f)
        new = [replace(g, indexed=False, learned=True) for g in more.fields if self.get(g.name) is None]
        return replace(self, fields=(*out, *new), version=self.version + bool(changed or new))

    def patch(self, indexed: dict[str, bool] | None = None, default_fields: tuple[str, ...] | None = None) -> Schema:
        """Fields made searchable or not, and other default fields."""
        for n in indexed or {}:
            if self.get(n) is None:
                raise SchemaError(f"no field '{n}'")
        fields = tuple(replace(f, indexed=indexed[f.name], learned=False) if f.name in (indexed or {}) else f for f in self.fields)
        return replace(self, fields=fields, default_fields=self.default_fields if default_fields is None else tuple(default_fields), version=self.version + 1)

    def describe(self) -> list[dict]:
        """One row a field: what can be done with it."""
        reached, _ = self.searched_by_default()
        rows = []
        for f in self.fields:
            row = {"name": f.name, "type": f.type, "searchable": f.indexed or f.shadow, "sortable": f.sortable, "default_search": f.name in reached, "returned": f.ghost is None, "list": f.many, "tokenizer": f.tokenizer if f.type == TEXT else None, "description": f.description}
            if f.name == "id" and self.shadow:
                row["returned_as"] = self.shadow.name
            if f.ghost:
                row["ghost"] = f.ghost.source
            rows.append(row)
        return rows


def widen(a: str, b: str) -> str:
    """The type that holds values of both."""
    if a == b:
        return a
    return F64 if a in NUMERIC and b in NUMERIC else TEXT


def type_of_spark(kind: T.DataType) -> tuple[str, bool]:
    """(type, whether a list) of a Spark column that nothing else is known about."""
    many = isinstance(kind, T.ArrayType)
    k = kind.elementType if many else kind
    if isinstance(k, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return I64, many
    if isinstance(k, T.DecimalType):
        return (U64 if k.scale == 0 and k.precision >= 20 else F64), many
    if isinstance(k, (T.FloatType, T.DoubleType)):
        return F64, many
    if isinstance(k, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATE, many
    if isinstance(k, T.BooleanType):
        return BOOLEAN, many
    if isinstance(k, T.BinaryType):
        return BYTES, many
    if isinstance(k, (T.StructType, T.MapType)):
        return JSON, many
    return TEXT, many


def schema_of(struct: T.StructType, **types: str | Field) -> Schema:
    """A schema for a DataFrame's columns; keyword arguments name types or whole fields where the Spark type doesn't say."""
    out = []
    for s in struct.fields:
        t, many = type_of_spark(s.dataType)
        said = types.get(s.name)
        out.append(said if isinstance(said, Field) else Field(s.name, TYPE_OF[said] if said else t, many=many))
    out += [f for n, f in types.items() if isinstance(f, Field) and f.ghost and n not in struct.names]
    return Schema(tuple(out))
