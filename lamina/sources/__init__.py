"""Readers and writers of layout and report files, and tables staged in the shared folder."""
