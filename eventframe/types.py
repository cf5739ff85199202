"""Logical C++ number types and their Spark types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import types as T


class UnsupportedFeature(NotImplementedError):
    """A construct that this engine knows but does not carry out."""


class ExpressionError(ValueError):
    """A string expression that can't be bound; raised when it is given, not when data flow."""


#: Kind: (rank, bits, signed, floating, Spark type, C++ name). Unsigned kinds live in the next wider Spark type.
KINDS = {
    "bool": (0, 1, False, False, T.BooleanType(), "bool"),
    "i8": (1, 8, True, False, T.ByteType(), "Char_t"),
    "u8": (1, 8, False, False, T.ShortType(), "UChar_t"),
    "i16": (2, 16, True, False, T.ShortType(), "Short_t"),
    "u16": (2, 16, False, False, T.IntegerType(), "UShort_t"),
    "i32": (3, 32, True, False, T.IntegerType(), "int"),
    "u32": (3, 32, False, False, T.LongType(), "unsigned int"),
    "i64": (4, 64, True, False, T.LongType(), "Long64_t"),
    "u64": (4, 64, False, False, T.LongType(), "ULong64_t"),
    "f32": (5, 32, True, True, T.FloatType(), "float"),
    "f64": (6, 64, True, True, T.DoubleType(), "double"),
    "str": (9, 0, False, False, T.StringType(), "string"),
}

#: Names that a cast may use.
CAST_NAMES = {
    "bool": "bool", "Bool_t": "bool", "char": "i8", "Char_t": "i8", "int8_t": "i8", "UChar_t": "u8", "uint8_t": "u8",
    "short": "i16", "Short_t": "i16", "int16_t": "i16", "UShort_t": "u16", "uint16_t": "u16",
    "int": "i32", "Int_t": "i32", "int32_t": "i32", "unsigned": "u32", "UInt_t": "u32", "uint32_t": "u32",
    "long": "i64", "Long_t": "i64", "Long64_t": "i64", "int64_t": "i64", "ULong64_t": "u64", "uint64_t": "u64", "size_t": "u64",
    "float": "f32", "Float_t": "f32", "double": "f64", "Double_t": "f64",
}


def floating(kind: str) -> bool:
    return KINDS[kind][3]


def integral(kind: str) -> bool:
    return kind != "str" and not floating(kind)


def spark_type(kind: str) -> T.DataType:
    return KINDS[kind][4]


def promoted(kind: str) -> str:
    """Integral promotion: whatever is narrower than int becomes int."""
    return "i32" if KINDS[kind][0] < 3 else kind


def common(a: str, b: str) -> str:
    """The type of an arithmetic operation on two kinds."""
    if "str" in (a, b):
        raise ExpressionError("strings have no arithmetic")
    a, b = promoted(a), promoted(b)
    if floating(a) or floating(b):
        return "f64" if "f64" in (a, b) else "f32"
    if KINDS[a][1] != KINDS[b][1]:
        return a if KINDS[a][1] > KINDS[b][1] else b
    return a if not KINDS[a][2] else b


@dataclass(frozen=True)
class Value:
    """A bound expression: a column, its element kind, and how many array levels it has.

    ``fields`` names the members of a tuple of collections (or of a struct).
    """

    column: Column
    kind: str
    depth: int = 0
    fields: tuple = ()

    @property
    def jagged(self) -> bool:
        return self.depth > 0

    def cpp(self) -> str:
        name = KINDS[self.kind][5] if self.kind in KINDS else self.kind
        for _ in range(self.depth):
            name = f"ROOT::VecOps::RVec<{name}>"
        return name


def array_of(kind: str, depth: int = 1) -> T.DataType:
    out = spark_type(kind)
    for _ in range(depth):
        out = T.ArrayType(out)
    return out


def kind_of(dtype: T.DataType) -> tuple[str, int, tuple]:
    """Kind, array depth and fields of a Spark type."""
    depth = 0
    while isinstance(dtype, T.ArrayType):
        dtype, depth = dtype.elementType, depth + 1
    for kind in ("bool", "i8", "i16", "i32", "i64", "f32", "f64", "str"):
        if isinstance(dtype, type(KINDS[kind][4])):
            return kind, depth, ()
    if isinstance(dtype, T.DecimalType):
        return "f64", depth, ()
    if isinstance(dtype, T.StructType):
        return "struct", depth, tuple((f.name, *kind_of(f.dataType)) for f in dtype.fields)
    return "opaque", depth, ()
