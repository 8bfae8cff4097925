"""Spellings and labels that decide results."""

# Text treated as missing, compared stripped and lower-cased.
NULL_SPELLINGS = ("", "na", "n/a", "nan", "null", "none", "-", "?", "sem dado")

# Boolean spellings, compared stripped and lower-cased.
TRUE_SPELLINGS = ("true", "verdadeiro", "sim", "s", "1", "yes")
FALSE_SPELLINGS = ("false", "falso", "não", "nao", "n", "0", "no")

# Cells the default pandas CSV reader takes for missing (exact match).
READER_NULLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

SEPARATORS = (",", ";", "\t", "|")

NUMERIC, CATEGORICAL, BOOLEAN, DATE, TEXT = "numeric", "categorical", "boolean", "date", "text"
KINDS = (NUMERIC, CATEGORICAL, BOOLEAN, DATE, TEXT)

IMPUTE_METHODS = {
    NUMERIC: ("mean", "median", "mode", "forward", "backward", "interpolate", "keep"),
    CATEGORICAL: ("mode", "forward", "backward", "keep"),
    BOOLEAN: ("mode", "forward", "backward", "keep"),
    DATE: ("forward", "backward", "keep"),
    TEXT: ("mode", "forward", "backward", "keep"),
}
OUTLIER_ACTIONS = ("keep", "clip", "null", "remove")
RULE_MODES = ("exact", "contains", "regex")
COMPARISONS = ("==", "!=", ">", ">=", "<", "<=")
FILTER_OPERATORS = COMPARISONS + ("contains", "not contains", "is null", "is not null")

# Portuguese labels found in existing configurations, and ours.
LABELS = {
    "numérico": NUMERIC, "categórico": CATEGORICAL, "booleano": BOOLEAN, "data": DATE, "texto": TEXT,
    "número": "number", "inteiro": "integer", "categoria": "category",
    "manter": "keep", "minúsculas": "lower", "MAIÚSCULAS": "upper", "Título": "title",
    "média": "mean", "mediana": "median", "moda": "mode", "anterior": "forward",
    "seguinte": "backward", "interpolar": "interpolate", "preservar": "keep",
    "forward fill": "forward", "backward fill": "backward", "interpolação linear": "interpolate",
    "valor fixo": "fixed", "automática (Pearson)": "auto",
    "limitar": "clip", "nulo": "null", "remover": "remove",
    "remover linhas": "remove", "limitar (winsorizar)": "clip", "substituir por nulo": "null",
    "exato": "exact", "contém": "contains", "não contém": "not contains",
    "é nulo": "is null", "não é nulo": "is not null",
}


def label(value):
    """English label of a configuration value; English values pass through."""
    return LABELS.get(value, value)
