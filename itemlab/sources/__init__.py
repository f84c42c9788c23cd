"""Reading and writing items, predictions, logs and reports."""
