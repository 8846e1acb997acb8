"""The spellings' keys, which the plans use too."""

from corpusmill.functions.spellings import LABELS, TAGS, aliases, facet_key, model_key, squeeze  # noqa: F401
