"""Spark-native engine for mail archives and training-data preparation."""

from maillake.options import CompressionError, ConvertOptions, ReadError, WorkerError

__all__ = ["AttachmentPart", "CompressionError", "CompressResult", "ConvertOptions", "ConvertStats", "ParsedMessage", "ReadError", "WorkerError", "compress_mbox", "convert", "iter_messages", "map_messages", "parse_message", "parse_messages", "read_mbox", "register", "write_tables"]
_HOME = {"CompressResult": "compress", "compress_mbox": "compress", "ConvertStats": "plans.convert", "convert": "plans.convert", "parse_messages": "functions.mime", "read_mbox": "sources.mbox", "iter_messages": "sources.mbox", "parse_message": "functions.mime", "map_messages": "functions.mime", "AttachmentPart": "functions.mime", "ParsedMessage": "functions.mime", "write_tables": "operators.sinks", "register": "functions.sql"}


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(name)
    from importlib import import_module

    return getattr(import_module(f"maillake.{_HOME[name]}"), name)
