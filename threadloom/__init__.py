"""threadloom: conversation logs, context windows and summary pyramids as Spark plans."""
