"""Training-data operators over tables of documents; nothing outside this subpackage imports it."""
