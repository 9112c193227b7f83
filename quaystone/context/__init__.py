"""What a text generator is told, and the pipeline around it."""
