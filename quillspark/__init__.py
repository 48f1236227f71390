"""quillspark: content analytics and training-data preparation as Spark plans."""
