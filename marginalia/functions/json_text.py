"""JSON as indented text, made from columns by expressions alone, in the form that requests to a model show their data in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The marks of a cut.
CUT_DATA = "\n... [TRUNCATED]"
CUT_TEXT = "\n... [TRUNCATED: section longer than the configured limit]"


def cut(col: Column, most: int | Column, mark: str = CUT_TEXT) -> Column:
    """The first characters and a mark where col is longer than most."""
    most = F.lit(most) if isinstance(most, int) else most
    return F.when(F.length(col) <= most, col).otherwise(F.concat(F.substring(col, F.lit(1), most.cast("int")), F.lit(mark)))


def quoted(col: Column) -> Column:
    whole = F.to_json(F.array(col))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _block(parts: Column, depth: int, ends: str) -> Column:
    """An array of lines, one level in, between the two signs of ends; the signs alone if there are none. parts is written into the
    expression once, as nested lists would else be computed again at each level."""
    pad = "\n" + " " * depth
    return F.replace(F.concat(F.lit(ends[0] + pad + " "), F.array_join(parts, "," + pad + " "), F.lit(pad + ends[1])), F.lit(ends[0] + pad + " " + pad + ends[1]), F.lit(ends))


def json_text(col: Column, kind: T.DataType | str, depth: int = 0, optional: frozenset[str] | set[str] = frozenset()) -> Column:
    """col, of the given type, as JSON with one blank for each level. Fields named in optional are left out where they are null or
    empty text; other nulls are null, but for null lists and maps, which are empty. Keys keep the order of the type's fields."""
    if isinstance(kind, str):
        kind = T.DataType.fromDDL(kind)
    if isinstance(kind, T.StructType):
        parts = []
        for f in kind:
            own = col[f.name]
            line = F.concat(F.lit(f'"{f.name}": '), json_text(own, f.dataType, depth + 1, optional))
            if f.name in optional:
                empty = own.isNull() | (own == "") if isinstance(f.dataType, T.StringType) else own.isNull()
                line = F.when(~empty, line)
            parts.append(line)
        lines = F.array(*parts)
        return _block(F.filter(lines, lambda x: x.isNotNull()) if optional & set(kind.names) else lines, depth, "{}")
    if isinstance(kind, T.ArrayType):
        return F.coalesce(_block(F.transform(col, lambda x: json_text(x, kind.elementType, depth + 1, optional)), depth, "[]"), F.lit("[]"))
    if isinstance(kind, T.MapType):
        lines = F.transform(F.map_entries(col), lambda e: F.concat(quoted(e["key"]), F.lit(": "), json_text(e["value"], kind.valueType, depth + 1, optional)))
        return F.coalesce(_block(lines, depth, "{}"), F.lit("{}"))
    return quoted(col) if isinstance(kind, T.StringType) else F.coalesce(col.cast("string"), F.lit("null"))


def as_json(df_type: T.StructType, name: str, most: int | Column | None = None, optional: frozenset[str] | set[str] = frozenset()) -> Column:
    """The named column of a frame with this schema as JSON text, cut to most characters."""
    out = json_text(F.col(name), df_type[name].dataType, 0, optional)
    return out if most is None else cut(out, most, CUT_DATA)
