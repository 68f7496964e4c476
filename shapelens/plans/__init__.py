"""Registered, oracle-checked queries over the testdata (imported for effect)."""

from shapelens.plans import keys  # noqa: F401
from shapelens.plans import documents  # noqa: F401
from shapelens.plans import catalog  # noqa: F401
from shapelens.plans import objects  # noqa: F401
from shapelens.plans import render  # noqa: F401
from shapelens.plans import streams  # noqa: F401
