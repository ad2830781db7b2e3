"""Marlstone: a PySpark-native engine that turns files and documents into queryable knowledge packs."""
