"""Readers and writers: files, recognised text, exports."""
