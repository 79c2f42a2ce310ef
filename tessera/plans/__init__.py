"""What a generation run is to do: schema, load phases, generation of a whole schema."""
