"""Operators of a training-data pipeline: quality, duplicates, decontamination, archives, tokens, language models, chats.

Nothing else in the library imports this subpackage.  Task functions travel by value, so executors need no copy of it.
"""

import barloom
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(barloom)
