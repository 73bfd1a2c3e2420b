"""All registered queries of this folder, and their SQL."""

from pairmatch.llm import bpe, chat, near_dup, neighbours, packing, pii, quality, resampling, secrets, sharding, toxicity, url_filter, whitening  # noqa: F401
from pairmatch.llm.common import RUN, SQL  # noqa: F401
