"""Named queries over the shared test tables, each with the same question as SQL text."""

from pairmatch.catalogue import (  # noqa: F401
    audit,
    blend,
    contracts,
    pairs,
    quality,
    sampling,
    split,
    storage,
    teacher,
    texts,
)
from pairmatch.catalogue.registry import QUERIES  # noqa: F401
