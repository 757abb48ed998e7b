"""Scriptoria: document and table analytics expressed as Spark DataFrame plans."""
