"""Text shaping for reports."""

from pyspark.sql import Column, functions as F

from trunkwatch.schema import LATIN, OBJECT_TYPE_NAMES


def transliterate(value: Column) -> Column:
    """Cyrillic to Latin. Letters that become one letter or none go in a single
    ``translate``; those that become several are replaced one by one."""
    single = [c for c, latin in LATIN.items() if len(latin) == 1]
    dropped = [c for c, latin in LATIN.items() if not latin]
    value = F.translate(value, "".join(single + dropped), "".join(LATIN[c] for c in single))
    for letter, latin in LATIN.items():
        if len(latin) > 1:
            value = F.replace(value, F.lit(letter), F.lit(latin))
    return value


def cut(value: Column, length: int) -> Column:
    return F.substring(F.coalesce(value, F.lit("-")), 1, length)


def object_type_name(object_type: Column) -> Column:
    name = F.coalesce(object_type, F.lit("-"))
    for code, shown in OBJECT_TYPE_NAMES.items():
        name = F.when(object_type == code, shown).otherwise(name)
    return name
