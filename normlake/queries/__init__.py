"""All registered queries; importing the package fills the registry."""

from normlake.queries import review, store, text, urls, verify  # noqa: F401
from normlake.queries.base import ORACLES, QUERIES  # noqa: F401
