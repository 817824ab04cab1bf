"""Where records come from: landed batches and a paged API."""
