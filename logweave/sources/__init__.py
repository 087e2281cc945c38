"""Readers: driver Parquet tables, syslog text files, program lists, dictionaries."""
