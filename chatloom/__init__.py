"""chatloom: Spark jobs over the conversation logs of coding assistants."""
