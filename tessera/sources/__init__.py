"""Sources: ontologies, documents, recorded responses of literature and registry services, JSON lines."""
