"""Spark-native processing of captured web pages: URLs, links, robots and sitemap
texts, tables, fields, monitors, scores and reports as DataFrame operators."""

__version__ = "0.1.0"
