"""Job settings in INI form: typed reading, writing, and the parameter grid of models."""

from __future__ import annotations

import ast
import configparser
import io
import itertools

from pyspark.sql import DataFrame, SparkSession

FIRST_YEAR, LAST_YEAR = 1979, 2019


def _typed(text: str):
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def read_config(text: str) -> dict[str, dict]:
    """Sections with typed values: Python literals where they are such, else strings. Names keep their case."""
    parser = configparser.ConfigParser(interpolation=None)
    parser.optionxform = str
    parser.read_string(text)
    return {s: {k: _typed(v) for k, v in parser[s].items()} for s in parser.sections()}


def write_config(config: dict[str, dict]) -> str:
    parser = configparser.ConfigParser(interpolation=None)
    parser.optionxform = str
    for section, values in config.items():
        parser[section] = {k: v if isinstance(v, str) else repr(v) for k, v in values.items()}
    out = io.StringIO()
    parser.write(out)
    return out.getvalue()


def valid_year(year: int) -> int:
    if not FIRST_YEAR <= year <= LAST_YEAR:
        raise ValueError(f"{year} is not within {FIRST_YEAR} to {LAST_YEAR}")
    return year


def parameter_grid(spark: SparkSession, models: dict[str, dict[str, list]]) -> DataFrame:
    """(model, flags) of every combination of each model's flags, as a map of strings."""
    rows = [(m, dict(zip(flags, map(str, values)))) for m, flags in models.items() for values in itertools.product(*flags.values())]
    return spark.createDataFrame(rows, "model string, flags map<string,string>")
